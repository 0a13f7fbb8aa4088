"""Jobs over documents with nested events: filtering, pruning, flattening, describing."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweave.fixed_values import EVENT_TAG_FIELDS
from newsweave.functions.dates import fill_moment_year, fill_period_year, partial_date
from newsweave.functions.names import standard_name, standard_place
from newsweave.functions.text import blank_to_null, let
from newsweave.schemas import ROLE_FIELDS
from newsweave.session import cut


def _filled(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) != ""


def has_time(event: Column) -> Column:
    when = event["time_position"]
    return _filled(when["moment"]) | _filled(when["period"])


def keep_timed_events(docs: DataFrame) -> DataFrame:
    """Only events with a time; documents without any are dropped."""
    kept = docs.withColumn("events", F.filter("events", has_time))
    return kept.where(F.size("events") > 0)


def _or_null(value: Column, present: Column) -> Column:
    return F.when(present, value)


def prune_event(event: Column) -> Column:
    """The event without trigger words, roles, emotions of roles, and without empty members."""
    when, where = event["time_position"], event["space_position"]
    who = event["relationship_characteristics"]

    def text(value: Column) -> Column:
        return F.nullif(value, F.lit(""))

    def group(members: dict[str, Column]) -> Column:
        packed = F.struct(*[v.alias(k) for k, v in members.items()])
        return F.when(F.coalesce(*members.values()).isNotNull(), packed)

    def name_only(field: str) -> Column:
        return F.when(text(who[field]["name"]).isNotNull(), F.struct(text(who[field]["name"]).alias("name")))

    def entries(values: Column) -> Column:
        kept = F.map_filter(values, lambda _, v: _filled(v))
        return F.when(F.size(kept) > 0, kept)

    roles = {f: name_only(f) for f in ROLE_FIELDS}
    packed_roles = F.struct(*[v.alias(k) for k, v in roles.items()])
    any_role = F.greatest(*[v.isNotNull().cast("int") for v in roles.values()]) == 1
    return F.struct(
        text(event["event_id"]).alias("event_id"),
        text(event["event_name"]).alias("event_name"),
        group({k: text(when[k]) for k in ("moment", "period")}).alias("time_position"),
        group({k: text(where[k]) for k in ("coordinate", "place_name", "region")}).alias("space_position"),
        F.when(any_role, packed_roles).alias("relationship_characteristics"),
        entries(event["attribute_characteristics"]).alias("attribute_characteristics"),
        entries(event["emotion_characteristics"]).alias("emotion_characteristics"),
    )


def standard_event(event: Column, as_of: Column, name: Callable[[Column], Column] = standard_name) -> Column:
    """The event with standard names and places, and with the year of ``as_of`` where a time has none."""
    when, where, who = event["time_position"], event["space_position"], event["relationship_characteristics"]
    roles = who
    for f in ROLE_FIELDS:
        role = F.when(who[f].isNotNull(), who[f].withField("name", name(who[f]["name"])))
        roles = roles.withField(f, role)
    time = when.withField("moment", fill_moment_year(when["moment"], as_of)).withField("period", fill_period_year(when["period"], as_of))
    place = where.withField("place_name", standard_place(where["place_name"], where["region"]))
    return event.withField("time_position", time).withField("space_position", place).withField("relationship_characteristics", roles)


def drop_bare_events(docs: DataFrame) -> DataFrame:
    """Drop events without any attribute."""
    return docs.withColumn(
        "events",
        F.filter("events", lambda e: F.coalesce(F.size(e["attribute_characteristics"]), F.lit(0)) > 0),
    )


def event_nodes(docs: DataFrame, attributes: Sequence[str] | None = None) -> DataFrame:
    """One flat row per event: prefixed members, role names, emotion words joined.

    Attributes that no column is made for stay together in the map ``attribute_other`` (null without any).
    """
    if attributes is None:
        listed = dict.fromkeys(f for fields in EVENT_TAG_FIELDS.values() for f in fields)
        attributes = [f.removeprefix("attribute_") for f in listed if f.startswith("attribute_")]
    keep = [c for c in docs.columns if c not in ("events", "event_relations")]
    event = F.col("e")
    who = event["relationship_characteristics"]
    return docs.select(*keep, F.explode("events").alias("e")).select(
        *keep,
        event["event_id"].alias("event_id"),
        event["event_name"].alias("event_name"),
        event["time_position"]["moment"].alias("time_position_moment"),
        event["time_position"]["period"].alias("time_position_period"),
        event["space_position"]["coordinate"].alias("space_position_coordinate"),
        event["space_position"]["place_name"].alias("space_position_place_name"),
        event["space_position"]["region"].alias("space_position_region"),
        *[F.nullif(who[f]["name"], F.lit("")).alias(f"relationship_characteristics_{f}") for f in ROLE_FIELDS],
        *[F.try_element_at(event["attribute_characteristics"], F.lit(a)).alias(f"attribute_{a}") for a in attributes],
        _others(event["attribute_characteristics"], list(attributes)).alias("attribute_other"),
        F.array_join(F.map_keys(event["emotion_characteristics"]), "；").alias("emotion_characteristics"),
        F.lit("0").alias("status"),
    )


def _others(attributes: Column, listed: list[str]) -> Column:
    """Filled entries whose key is not listed."""
    rest = F.map_filter(attributes, lambda k, v: ~k.isin(listed) & _filled(v))
    return F.when(F.size(rest) > 0, rest)


def evolution_event(event: Column, as_of: Column) -> Column:
    """The short form of an event for the evolution table."""
    when = event["time_position"]
    moment = F.coalesce(F.nullif(when["moment"], F.lit("")), when["period"])
    name = F.coalesce(event["event_name"], F.lit(""))
    who = event["relationship_characteristics"]
    roles = F.array(
        *[
            F.struct(
                who[f]["name"].alias("entity"),
                F.coalesce(who[f]["role"], F.lit("")).alias("role"),
                F.coalesce(who[f]["emotion"], F.lit("")).alias("emotion"),
            )
            for f in ROLE_FIELDS
        ]
    )

    def short(day: Column) -> Column:
        return F.struct(
            F.when(day != "", F.concat_ws("-", day, name)).otherwise(name).alias("id"),
            event["event_id"].alias("event_id"),
            F.coalesce(F.try_element_at(event["attribute_characteristics"], F.lit("event_type")), F.lit("")).alias("type"),
            day.alias("date"),
            F.coalesce(event["space_position"]["place_name"], F.lit("")).alias("place"),
            event["trigger_word"].alias("triggers"),
            F.filter(roles, lambda r: _filled(r["entity"])).alias("roles"),
        )

    return let(partial_date(moment, as_of, [event["event_name"]]), short)


def event_description(event: Column) -> Column:
    """Labelled parts of an event in one line; absent parts leave no trace."""
    when, where = event["time_position"], event["space_position"]
    who, what = event["relationship_characteristics"], event["attribute_characteristics"]

    def labelled(label: str, value: Column) -> Column:
        return F.when(_filled(value), F.concat(F.lit(label), value))

    def attribute(key: str) -> Column:
        return F.try_element_at(what, F.lit(key))

    triggers = F.array_join(F.filter(event["trigger_word"], _filled), "、")
    place = F.coalesce(F.nullif(where["place_name"], F.lit("")), where["region"])
    order = ["subject_person", "related_party_person", "subject_organization", "related_party_organization"]
    people = F.concat_ws(", ", *[F.nullif(who[f]["name"], F.lit("")) for f in order])
    parts = F.concat_ws(
        "；",
        F.nullif(event["event_name"], F.lit("")),
        labelled("触发词: ", triggers),
        labelled("时间: ", when["moment"]),
        labelled("地点：", place),
        labelled("涉及人物/组织: ", people),
        labelled("关键动作：", attribute("key_action")),
        labelled("军事手段：", attribute("military_means")),
        labelled("政策工具：", attribute("policy_tool")),
        labelled("类型: ", attribute("event_type")),
        labelled("机场：", attribute("airport")),
        labelled("港口：", attribute("port")),
    )
    return F.concat(event["event_id"], F.lit(": "), parts)


def similarity_text(event: Column) -> Column:
    """Name and role names, the text two events are compared by."""
    who = event["relationship_characteristics"]
    named = [
        F.when(_filled(who[f]["name"]), F.concat(F.lit(f"{f}:"), who[f]["name"], F.lit("()"))) for f in ROLE_FIELDS
    ]
    return F.trim(F.concat_ws(" ", event["event_name"], *named))


def info_count(event: Column) -> Column:
    """How many of time, place, attributes and roles an event has."""
    when, where = event["time_position"], event["space_position"]
    who = event["relationship_characteristics"]
    present = [
        _filled(when["moment"]) | _filled(when["period"]),
        _filled(where["coordinate"]) | _filled(where["place_name"]) | _filled(where["region"]),
        F.coalesce(F.size(event["attribute_characteristics"]), F.lit(0)) > 0,
        F.greatest(*[_filled(who[f]["name"]).cast("int") for f in ROLE_FIELDS]) == 1,
    ]
    return sum((p.cast("long") for p in present), F.lit(0).cast("long"))


def split_by_text(docs: DataFrame, content: str, title: str) -> tuple[DataFrame, DataFrame]:
    """Documents with some text, and rejected ones with the reason."""
    text = F.coalesce(blank_to_null(F.col(content)), blank_to_null(F.col(title)))
    marked = docs.withColumn("text", text)
    accepted = marked.where(F.col("text").isNotNull())
    rejected = marked.where(F.col("text").isNull()).drop("text").withColumn("reason", F.lit("内容为空"))
    return accepted, rejected


def flatten_json(df: DataFrame, key: str, payload: str) -> DataFrame:
    """Long form of nested JSON of any depth: dotted path and value; lists count their elements from 0.

    Each round explodes objects and lists alike, once, and checkpoints; the last round is the depth of the
    deepest payload. Lists inside lists stay values. Payloads that are no object have no rows.
    """
    spark = df.sparkSession
    level = df.select(F.col(key), F.lit("").alias("path"), F.parse_json(payload).alias("v"), F.lit(False).alias("in_list"))
    level = level.where(F.schema_of_variant("v").like("OBJECT%"))
    done = None
    while True:
        step = spark.sql(
            f"""SELECT t.`{key}`, concat_ws('.', nullif(t.path, ''), coalesce(x.key, CAST(x.pos AS STRING))) AS path,
                       x.value AS v, schema_of_variant(x.value) AS kind, t.in_list
                FROM {{level}} t, LATERAL variant_explode(t.v) x""",
            level=level,
        )
        is_list = F.col("kind").like("ARRAY%") & ~F.col("in_list")
        rows = cut(step.withColumn("nested", F.col("kind").like("OBJECT%") | is_list).withColumn("in_list", is_list).drop("kind"))
        leaves = rows.where(~F.col("nested")).select(key, "path", F.col("v").cast("string").alias("value"))
        done = leaves if done is None else done.unionByName(leaves)
        level = rows.where("nested").select(key, "path", "v", "in_list")
        if level.isEmpty():
            return done


def describe_node(node: Column, properties: Column) -> Column:
    """``id (key: value, …)`` without empty values and bookkeeping keys."""
    kept = F.map_filter(properties, lambda k, v: _filled(v) & ~k.isin("vid", "tag", "vertex_id"))
    listed = F.array_join(
        F.transform(F.map_entries(kept), lambda e: F.concat_ws(": ", e["key"], e["value"])), ", "
    )
    return F.when(F.size(kept) > 0, F.concat(node, F.lit(" ("), listed, F.lit(")"))).otherwise(node)
