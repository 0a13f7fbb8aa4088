"""Graph completion: translation embeddings and the completion query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweave.fixed_values import (
    COMPLETION_CONF,
    COMPLETION_RECALL,
    COMPLETION_RERANK,
    COMPLETION_RETURN,
    RELATION_ALIASES,
)
from newsweave.functions.text import map_lookup
from newsweave.operators.nearest import k_nearest
from newsweave.operators.ranking import number_rows, top_n_per_key
from newsweave.session import cut

MODEL_SCORE = 0.05
#: True tails and relations up to which their vectors are sent to all tasks.
FEW = 10_000


def relation_name(relation: Column) -> Column:
    return F.coalesce(map_lookup(relation, RELATION_ALIASES), relation)


def completion_tasks(graph: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Distinct questions (h, r, ?) and (?, r, t) about known entities and relations.

    ``graph`` has h, r, t; ``entities`` id and vec; ``relations`` r and vec. The target vector is
    h + r for a missing tail and t - r for a missing head. ``answers`` are all ends already known
    for a question.
    """
    named = graph.withColumn("r", relation_name(F.col("r")))
    sides = F.array(
        F.struct(F.lit("(h,r,?)").alias("kind"), F.col("h").alias("src"), F.col("t").alias("answer")),
        F.struct(F.lit("(?,r,t)").alias("kind"), F.col("t").alias("src"), F.col("h").alias("answer")),
    )
    asked = named.select("r", F.inline(sides))
    questions = asked.select("kind", "src", "r").distinct()
    known = questions.join(entities.select(F.col("id").alias("src"), F.col("vec").alias("_e")), "src").join(
        relations.select("r", F.col("vec").alias("_r")), "r"
    )
    sign = F.when(F.col("kind") == "(h,r,?)", 1.0).otherwise(-1.0)
    target = F.zip_with("_e", "_r", lambda e, r: e + sign * r)
    numbered = number_rows(known.select("kind", "src", "r", target.alias("vec")), [], ["kind", "r", "src"], "task")
    return cut(numbered)


def known_answers(graph: DataFrame) -> DataFrame:
    named = graph.withColumn("r", relation_name(F.col("r")))
    tails = named.select(F.lit("(h,r,?)").alias("kind"), F.col("h").alias("src"), "r", F.col("t").alias("id"))
    heads = named.select(F.lit("(?,r,t)").alias("kind"), F.col("t").alias("src"), "r", F.col("h").alias("id"))
    return tails.unionByName(heads).distinct()


def nearest_candidates(tasks: DataFrame, entities: DataFrame, topk: int = COMPLETION_RECALL) -> DataFrame:
    """The nearest entities of each question with score 1 / (1 + distance), the asked one left out."""
    near = k_nearest(tasks.select("task", "vec"), entities, topk, norm=1)
    named = near.join(tasks.select("task", "kind", "src", "r"), "task")
    others = named.where(F.col("id") != F.col("src"))
    return others.withColumn("score_kge", 1.0 / (1.0 + F.col("distance")))


def shortlist(
    candidates: DataFrame, answers: DataFrame, conf: float = COMPLETION_CONF,
    rerank: int = COMPLETION_RERANK, max_return: int | None = COMPLETION_RETURN, model_score: float = MODEL_SCORE,
) -> DataFrame:
    """The first candidates per question, known answers excluded, fused, filtered, best ones first."""
    first = top_n_per_key(candidates, ["task"], [F.col("rank")], rerank, spread=False)
    fresh = first.join(answers, ["kind", "src", "r", "id"], "left_anti")
    fused = fresh.withColumn("score_llm", F.lit(model_score)).withColumn(
        "score_fused", F.col("score_kge") * 0.9 + F.col("score_llm")
    )
    kept = fused.where(F.col("score_fused") >= conf)
    order = [F.desc(F.round("score_fused", 9)), F.col("kind"), F.col("r"), F.col("src"), F.col("id")]
    return kept.orderBy(*order).limit(max_return) if max_return else kept


def named_suggestions(suggestions: DataFrame, names: DataFrame) -> DataFrame:
    """Suggestions as triples of ids and of readable names."""
    tail_missing = F.col("kind") == "(h,r,?)"
    triples = suggestions.withColumn("h", F.when(tail_missing, F.col("src")).otherwise(F.col("id"))).withColumn(
        "t", F.when(tail_missing, F.col("id")).otherwise(F.col("src"))
    )
    heads = names.select(F.col("id").alias("h"), F.col("name").alias("h_name"))
    tails = names.select(F.col("id").alias("t"), F.col("name").alias("t_name"))
    return triples.join(heads, "h", "left").join(tails, "t", "left").select(
        F.col("kind").alias("task"), "h", "r", "t", "h_name", "t_name", "score_kge", "score_llm", "score_fused"
    )


# -- translation embeddings ------------------------------------------------------------------


def start_vector(number: Column, dim: int, salt: int) -> Column:
    """Uniform start vector from the hash of id and position; no state, the same in every run."""
    bound = (6.0 / dim) ** 0.5

    def value(j: Column) -> Column:
        return (F.pmod(F.xxhash64(number, j, F.lit(salt)), F.lit(2000001)) / 1000000.0 - 1.0) * bound

    return F.transform(F.sequence(F.lit(1), F.lit(dim)), value)


def relation_key(number: Column) -> Column:
    """Relations stand below zero in the table of all vectors."""
    return -1 - number


def few_of(vectors: DataFrame, ids: DataFrame, few: bool) -> DataFrame:
    """The vectors of ``ids``; few of them are sent to all tasks, as a join by a common tail or relation would meet in one."""
    return F.broadcast(vectors.join(F.broadcast(ids), "id", "left_semi")) if few else vectors


def _descend(vectors: DataFrame, gradients: DataFrame, dim: int, rate: float) -> DataFrame:
    """Step against the mean gradient of each id, with the losses summed per id; sums are combined per partition before the shuffle."""
    sums = gradients.groupBy("id").agg(
        F.count("g").alias("_n"), F.sum("loss").alias("loss"), *[F.sum(F.col("g")[i]).alias(f"_g{i}") for i in range(dim)]
    )
    step = F.when(F.col("_n") > 0, F.array(*[F.col(f"_g{i}") / F.col("_n") for i in range(dim)]))
    moved = vectors.select("id", "vec").join(sums.select("id", "loss", step.alias("_step")), "id", "left")
    new = F.when(F.col("_step").isNull(), F.col("vec")).otherwise(F.zip_with("vec", "_step", lambda v, s: v - rate * s))
    return moved.select("id", new.alias("vec"), "loss")


def train_translations(
    triples: DataFrame, entities: DataFrame, relations: DataFrame, dim: int = 128, epochs: int = 100,
    margin: float = 1.0, rate: float = 0.05,
) -> tuple[DataFrame, DataFrame, list[float]]:
    """Vectors of entities and relations such that h + r is near t (L1, margin ranking).

    ``triples`` has h, r, t as 0-based numbers, ``entities`` and ``relations`` an id column. One epoch
    is one full-batch gradient step: triples meet their four vectors, gradients are summed per id, and
    only the new vectors are written out. The start vectors of the first epoch follow from the ids, so
    it needs no join. Later, a triple travels to its head, and with h + r to its corrupted tail; relations and
    true tails are sent to all tasks where they are at most FEW, else joined. The corrupted tail of a triple
    follows from its hash and the epoch.
    Returns (entity vectors, relation vectors, mean loss per epoch).
    """
    kind = dict(entities.dtypes)["id"]
    triples = cut(triples.select("h", "r", "t"))
    named = relations.select("id", start_vector(F.col("id"), dim, 2).alias("vec"))
    starts = entities.select("id", start_vector(F.col("id"), dim, 1).alias("vec"))
    starts = starts.unionByName(named.select(relation_key(F.col("id")).cast(kind).alias("id"), "vec"))
    vectors = cut(starts)
    size, total = entities.count(), triples.count()
    tails, kinds = [cut(triples.select(c.cast(kind).alias("id")).distinct()) for c in (F.col("t"), relation_key(F.col("r")))]
    few_tails, few_kinds = tails.count() <= FEW, kinds.count() <= FEW
    losses = []
    for epoch in range(epochs):
        rows = triples.withColumn("n", F.pmod(F.xxhash64("h", "r", "t", F.lit(epoch)), F.lit(size)))
        if epoch == 0:
            first = {"vh": start_vector(F.col("h").cast(kind), dim, 1), "vt": start_vector(F.col("t").cast(kind), dim, 1)}
            first |= {"vn": start_vector(F.col("n").cast(kind), dim, 1), "vr": start_vector(F.col("r"), dim, 2)}
            rows = rows.withColumns(first).withColumn("hr", F.zip_with("vh", "vr", lambda a, b: a + b))
        else:
            ent = vectors.where(F.col("id") >= 0)
            ends = ent.select(F.col("id").alias("h"), F.col("vec").alias("vh"))
            named = few_of(vectors.where(F.col("id") < 0), kinds, few_kinds).select(relation_key(F.col("id")).alias("r"), F.col("vec").alias("vr"))
            rows = rows.join(ends, "h").join(named, "r").select("h", "r", "t", "n", F.zip_with("vh", "vr", lambda a, b: a + b).alias("hr"))
            rows = rows.join(ent.select(F.col("id").alias("n"), F.col("vec").alias("vn")), "n")
            rows = rows.join(few_of(ent, tails, few_tails).select(F.col("id").alias("t"), F.col("vec").alias("vt")), "t")
        gaps = rows.withColumn("gt", F.zip_with("hr", "vt", lambda a, b: a - b)).withColumn(
            "gn", F.zip_with("hr", "vn", lambda a, b: a - b)
        )

        def length(column: str) -> Column:
            return F.aggregate(column, F.lit(0.0), lambda acc, x: acc + F.abs(x))

        scored = gaps.withColumn("loss", F.greatest(F.lit(0.0), F.lit(margin) + length("gt") - length("gn")))
        to_t = F.transform("gt", lambda x: F.signum(x))
        to_n = F.transform("gn", lambda x: F.signum(x))
        signs = scored.select("h", "r", "t", "n", "loss", to_t.alias("st"), to_n.alias("sn"))
        signs = signs.withColumn("both", F.zip_with("st", "sn", lambda a, b: a - b))

        def part(number: Column, g: Column, loss: Column) -> Column:
            return F.struct(number.cast(kind).alias("id"), g.alias("g"), loss.alias("loss"))

        relation = relation_key(F.col("r"))
        active = F.array(
            part(relation, F.col("both"), F.col("loss")),
            part(F.col("h"), F.col("both"), F.lit(0.0)),
            part(F.col("t"), F.transform("st", lambda x: -x), F.lit(0.0)),
            part(F.col("n"), F.col("sn"), F.lit(0.0)),
        )
        idle = F.array(part(relation, F.lit(None).cast("array<double>"), F.lit(0.0)))
        parts = signs.select(F.inline(F.when(F.col("loss") > 0, active).otherwise(idle)))
        vectors = cut(_descend(vectors, parts, dim, rate))
        summed = vectors.where(F.col("id") < 0).agg(F.sum("loss")).first()[0]
        losses.append(float(summed or 0.0) / max(1, total))
    ent = vectors.where(F.col("id") >= 0).select("id", "vec")
    rel = vectors.where(F.col("id") < 0).select(relation_key(F.col("id")).alias("id"), "vec")
    return ent, rel, losses
