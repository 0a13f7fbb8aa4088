"""Word lists, lookup tables, limits and patterns that decide the results.

They are stated as plain text in their natural order. Everything here can be replaced by an
argument of the job that uses it.
"""

# Limits and weights -------------------------------------------------------------------------
DOCS_PER_SOURCE = 5000
CLAIM_PER_SOURCE = 100
COMMENTS_PER_POST = 20
ROWS_PER_KEYWORD = 20
TRIGGER_ROWS = 50
TRIGGER_WAIT_SECONDS = 1800
HOT_REFRESH_ROWS = 200
MIN_CLUSTER_SIZE = 4
MIN_SAMPLES = 2
HOT_VOLUME_WEIGHT = 0.6
HOT_RECENCY_WEIGHT = 0.3
HOT_DIVERSITY_WEIGHT = 0.1
HOT_RECENCY_DAYS = 7
HOT_EVENTS_KEPT = 10
TITLE_LENGTH = 20
SUMMARY_CHARS = 200
FACTS_PER_EVENT = 120
WORD_CLOUD_TOP = 40
TRIPLES_EXPORTED = 20000
NAME_RATIO = 0.7
TEXT_COSINE = 0.9
COMPLETION_CONF = 0.1
COMPLETION_RECALL = 120
COMPLETION_RERANK = 20
COMPLETION_RETURN = 5
CORRECTION_THRESHOLD = -16.0
CORRECTION_CONTEXT = 6

# Word-cloud stop words ----------------------------------------------------------------------
STOP_WORDS = [
    "编辑", "责任编辑", "记者", "责编", "新华社", "李学仁", "韩墨", "杨依军", "丁林", "王佳宁", "责任", "进行", "日电", "北京",
    "广东", "我们", "一个", "指出", "对此", "发言人", "任何", "活动", "没有", "加征", "协议", "时间", "通过", "认为", "影响",
    "亿美元", "###", "相关", "代表",
]

# Titles -------------------------------------------------------------------------------------
SENSATIONAL_WORDS = ["重磅", "震撼", "史无前例", "惨", "怒", "惊天", "核打击", "歼灭", "血洗"]
ACTION_WORDS = [
    "演习", "会见", "访台", "对峙", "制裁", "表决", "通过", "爆发", "坠毁", "集会", "抗议", "谈判", "合作", "签署", "启动", "通报",
    "搜救", "停火", "冲突",
]

# Event ids, target ids and tags -------------------------------------------------------------
EVENT_TAGS = {"Th_ECON": "economic_event", "Th_MIL": "military_event", "Th_POL": "political_event"}
TARGET_TAGS = {
    "PORT-": "port_target",
    "AIR-": "airport_target",
    "PER-": "person_target",
    "ORG-": "organization_target",
    "WAR-": "warship_target",
}
TARGET_KINDS = {"人物目标": "人物", "组织目标": "组织", "机场目标": "机场", "港口目标": "港口", "军舰目标": "军舰"}
OTHER_KIND = "其他"
KINDS_BY_TYPE = {
    "character": ["人物目标"],
    "organization": ["组织目标"],
    "facility": ["机场目标", "港口目标"],
    "unknow": ["人物目标", "组织目标"],
}

# Relations ----------------------------------------------------------------------------------
EVENT_EVENT_RELATIONS = [
    "event-link-link", "event-link-parallel", "event-link-includes", "event-link-overlap", "event-link-alternative",
    "event-causal-trigger", "event-causal-result", "event-causal-condition", "event-causal-suppress",
    "event-causal-successor", "event-causal-reason", "event-causal-dependency", "event-causal-constraint",
    "event-evolution-leadsTo", "event-evolution-cause", "event-evolution-promote", "event-evolution-escalate",
    "event-evolution-deescalate", "event-evolution-transfer",
    "event-combination-subEvent", "event-combination-stage", "event-combination-parallelTask",
]
EVENT_TARGET_RELATIONS = [
    "event-target-facility-occursAtAirport", "event-target-facility-occursAtPort",
    "event-target-facility-affectsAirport", "event-target-facility-affectsPort",
    "event-target-organization-subjectOrganization", "event-target-organization-relatedOrganization",
    "event-target-organization-superiorCommandOrganization", "event-target-organization-affectedOrganization",
    "event-target-person-subjectPerson", "event-target-person-relatedPerson",
    "event-target-person-leaderOrSpokesperson", "event-target-person-affectedPerson",
]
# (kind of the source, its field, relation, kind of the target)
TARGET_RELATION_FIELDS = [
    ("人物目标", "affiliated_organization", "person-personOrganization-affiliated", "组织目标"),
    ("组织目标", "superior_organization", "organization-organization-superior", "组织目标"),
    ("组织目标", "subordinate_units", "organization-organization-subordinate", "组织目标"),
    ("组织目标", "international_cooperation", "organization-organization-joint", "组织目标"),
    ("组织目标", "leader", "target-target-position-leader", "人物目标"),
    ("机场目标", "operation_operator", "target-target-operation-operatedBy", "组织目标"),
    ("港口目标", "operator", "target-target-operation-operatedBy", "组织目标"),
    ("军舰目标", "command_unit", "target-target-operation-commandedBy", "组织目标"),
]
CORRECTION_EVENT_RELATIONS = [*EVENT_EVENT_RELATIONS, "RELATED_TO", "PARALLEL_WITH", "INVOLVES", "INCLUDES", "CONDUCTED_BY"]
CORRECTION_TARGET_RELATIONS = [
    "event-target-facility-occursAtAirport", "event-target-organization-subjectOrganization",
    "event-target-person-subjectPerson", "CONDUCTED_BY", "INVOLVES",
]
RELATION_ALIASES = {"CONDUCTED_BY": "event_target_rel", "RELATED_TO": "event_event_rel"}
CORRECTED = "符合阈值，成功修改并插入"
NOT_CORRECTED = "不符合阈值条件，不修改"
HEAD_EVENT_WORDS = ["表示", "反对", "强调", "访问"]
HEAD_ORGANIZATION_WORDS = ["外交部", "学会", "国会", "国台办"]
HEAD_PERSON_WORDS = ["人", "王毅", "郭嘉昆"]

# Node columns per tag -----------------------------------------------------------------------
_EVENT_HEAD = ["event_name", "event_first_level", "event_second_level", "time_position_moment"]
_EVENT_ROLES = [
    "relationship_characteristics_subject_person", "relationship_characteristics_subject_organization",
    "relationship_characteristics_related_party_person", "relationship_characteristics_related_party_organization",
]
EVENT_TAG_FIELDS = {
    "economic_event": [
        *_EVENT_HEAD, "space_position_region", *_EVENT_ROLES, "attribute_event_type", "attribute_policy_tool",
        "attribute_economic_indicator", "attribute_port", "attribute_airport", "emotion_characteristics",
    ],
    "military_event": [
        *_EVENT_HEAD, "space_position_place_name", *_EVENT_ROLES, "attribute_event_type", "attribute_background",
        "attribute_military_means", "attribute_casualty", "attribute_strategic_goal", "attribute_command_level",
        "attribute_port", "attribute_airport", "emotion_characteristics",
    ],
    "political_event": [
        *_EVENT_HEAD, "space_position_place_name", *_EVENT_ROLES, "attribute_event_type", "attribute_background",
        "attribute_key_action", "attribute_port", "attribute_airport", "emotion_characteristics",
    ],
}
TARGET_TAG_FIELDS = {
    "person_target": [
        "name", "alias", "location", "coordinate", "gender", "ethnicity_religion", "nationality", "family_members",
        "affiliated_organization", "rank_position", "event_second_level", "type",
    ],
    "organization_target": [
        "name", "alias", "superior_organization", "subordinate_units", "functions", "location", "coordinate",
        "personnel_size", "leader", "creation_time_history", "international_cooperation", "source_url",
        "event_first_level", "event_second_level", "type",
    ],
    "port_target": [
        "name", "alias", "un_locode", "port_code", "location", "operator", "status", "coordinate", "waterway_type",
        "area_ha", "coastline_length_m", "berths_count", "berths_max_depth_m", "container_terminals_count",
        "bulk_terminals_count", "passenger_terminals_count", "storage_capacity_tons", "cranes_count",
        "rail_connection", "road_connection", "max_vessel_size_dwt", "annual_throughput_teu",
        "annual_throughput_tons", "annual_passenger_volume", "main_cargo_types", "shipping_lines",
        "international_status", "opened_date", "imo_number", "customs_availability", "pilotage_required",
        "environmental_certifications", "notes", "source_url", "event_first_level", "event_second_level", "type",
    ],
    "airport_target": [
        "name", "alias", "iata_code", "icao_code", "location", "coordinate", "location_elevation_m",
        "facilities_runways_count", "facilities_runways_lengths_m", "facilities_terminals",
        "facilities_parking_positions", "operation_opened_date", "operation_operator", "operation_major_airlines",
        "traffic_passengers_per_year", "traffic_cargo_tons_per_year", "source_url", "event_first_level",
        "event_second_level", "type",
    ],
    "warship_target": [
        "name", "alias", "formation_type", "command_unit", "home_port", "status", "mission_roles",
        "operational_area", "task_force_designation", "exercise_participation", "total_ships_count",
        "ship_types_distribution", "flagship_name", "command_ship_class", "support_vessels_count",
        "submarines_count", "aircraft_embarked", "missile_systems", "air_defense_capability", "asw_capability",
        "amphibious_support", "mine_warfare_capability", "commander_name", "chain_of_command",
        "communication_systems", "year_established", "recent_upgrades", "alliances_or_exercises",
        "notable_operations", "notes", "source_url", "event_first_level", "event_second_level", "type",
    ],
}

# Topics -------------------------------------------------------------------------------------
TOPIC_PREFIXES = {"台海经济": "Th_ECON", "台海军事": "Th_MIL", "台海政治": "Th_POL"}
FAILED_TOPIC = "处理失败"

# Sources ------------------------------------------------------------------------------------
SOURCE_LABELS = [("cctv", "CCTV"), ("toutiao", "头条"), ("weibo", "微博"), ("xinhua", "新华网"), ("cnn", "CNN")]
BODY_CLASSES = ["content_18313", "content_19568", "cnt_bd"]
LINK_HOSTS = ["toutiao.com", "snssdk.com"]
LINK_EXCLUDED = ["/video/", "search?", "user/token"]

# Names --------------------------------------------------------------------------------------
SYNONYMS = {
    "中方": "中国", "大陆": "中国", "美方": "美国", "英方": "英国", "法方": "法国", "日方": "日本", "韩方": "韩国", "朝方": "朝鲜",
    "俄方": "俄罗斯", "德方": "德国", "加方": "加拿大", "澳方": "澳大利亚", "欧盟": "欧洲联盟", "中华民国": "台湾",
    "中国台湾": "台湾", "台湾地区": "台湾", "台湾当局": "台湾", "港方": "中国香港", "澳门当局": "中国澳门",
    "联合国": "联合国组织", "北约": "北大西洋公约组织", "世贸组织": "世界贸易组织", "世卫组织": "世界卫生组织",
    "上合组织": "上海合作组织", "东盟": "东南亚国家联盟", "APEC": "亚太经济合作组织", "UN": "联合国",
    "United Nations": "联合国", "NATO": "北大西洋公约组织", "North Atlantic Treaty Organization": "北大西洋公约组织",
    "EU": "欧盟", "European Union": "欧盟", "BRICS": "金砖国家", "金砖五国": "金砖国家", "ASEAN": "东盟",
    "Association of Southeast Asian Nations": "东盟", "G20": "二十国集团", "五角大楼": "美国国防部", "G7国家": "七国集团",
    "G7": "七国集团", "七国集团": "七国集团", "Group of Seven": "七国集团", "G7 Summit": "七国集团",
    "央视": "中国中央电视台", "新华社": "新华社通讯社", "人民日报": "人民日报社", "CNN": "美国有线电视新闻网",
    "BBC": "英国广播公司", "NHK": "日本放送协会", "法新社": "法国新闻社", "路透社": "路透社通讯社", "大陆外交部": "外交部",
    "佩洛西": "南希·佩洛西", "布林肯": "安东尼·布林肯", "拜登": "乔·拜登", "乔拜登": "乔·拜登", "拜登总统": "乔·拜登",
    "特朗普": "唐纳德·特朗普", "普京": "弗拉基米尔·普京", "马克龙": "埃马纽埃尔·马克龙", "岸田": "岸田文雄",
    "安倍": "安倍晋三", "默克尔": "安格拉·默克尔", "约翰逊": "鲍里斯·约翰逊", "泽连斯基": "弗拉基米尔·泽连斯基",
    "哈里斯": "卡玛拉·哈里斯", "习主席": "习近平",
    "解放军": "中国人民解放军", "人民解放军": "中国人民解放军", "海军陆战队": "美国海军陆战队",
    "太平洋舰队": "美国太平洋舰队",
    "中美": "中国与美国", "中日": "中国与日本", "中俄": "中国与俄罗斯", "日韩": "日本与韩国", "美俄": "美国与俄罗斯",
    "美欧": "美国与欧洲联盟",
}
BANNED_KEYWORDS = [
    "亲属", "人员", "员工", "用户", "商人", "记者", "网民", "家人", "顽固分子", "某些国家", "发展中国家", "政要", "网友", "领域",
    "市场", "产业", "民众", "群众", "市民", "官员", "代表", "议员", "农民", "学生", "居民", "百姓",
    "等国", "等国政要", "代表团", "组织方", "方面", "机构", "部门", "多个", "若干", "若干个", "部分", "一些", "若干海外华人",
    "团体", "相关", "全体", "分子", "同胞", "政客",
    "促进会", "原则", "发展", "技术", "渔民",
    "台商", "外商", "友人", "访客", "参观者", "公司", "地图", "某人", "不详", "未知", "测试", "样例", "示例", "假名", "暂无",
    "佚名", "匿名", "无名", "虚构", "传闻", "谣言", "疑似",
]
BANNED_SUFFIXES = ["者", "们", "员"]
EMBASSY_WORDS = ["大使馆", "领事馆", "代表处", "驻"]
TITLE_PREFIXES = ["总统", "总理", "首相", "部长", "大使", "国务卿", "书记", "主席"]

# Places -------------------------------------------------------------------------------------
PLACE_NAMES = {
    "中国大陆": "中国", "大陆": "中国", "中华人民共和國": "中国", "中华人民共和国": "中国", "中華人民共和國": "中国", "中方": "中国",
    "华夏": "中国", "天朝": "中国",
    "北京": "北京市", "京城": "北京市", "上海": "上海市", "沪": "上海市", "天津": "天津市", "津": "天津市", "广东": "广东省",
    "粤": "广东省", "广州": "广州市", "深圳": "深圳市", "福建": "福建省", "福州": "福州市", "厦门": "厦门市", "浙江": "浙江省",
    "杭州": "杭州市", "宁波": "宁波市", "钓鱼台": "钓鱼岛",
    "台湾地区": "台湾省", "台湾地区当局": "台湾省", "中华民国": "台湾省", "台北当局": "台湾省", "台湾当局": "台湾省",
    "台北": "台北市", "宝岛": "台湾省", "台方": "台湾省", "高雄": "高雄市", "台中": "台中市", "台南": "台南市",
    "桃园": "桃园市", "基隆": "基隆市", "花莲": "花莲县", "金门": "金门县", "马祖": "连江县", "澎湖": "澎湖县", "台东": "台东县",
    "香港特别行政区": "香港", "香江": "香港", "东方之珠": "香港", "澳门特别行政区": "澳门", "濠江": "澳门",
    "美利坚合众国": "美国", "美利堅合眾國": "美国", "美方": "美国", "美帝": "美国", "美洲合众国": "美国", "USA": "美国",
    "U.S.A.": "美国", "U.S.": "美国", "United States": "美国", "Washington": "美国",
    "俄罗斯联邦": "俄罗斯", "俄联邦": "俄罗斯", "俄方": "俄罗斯", "俄国": "俄罗斯", "莫斯科当局": "俄罗斯",
    "日本国会": "日本东京", "日本议会": "日本东京", "日本国会大厦": "日本东京", "日本国": "日本", "日方": "日本", "东瀛": "日本",
    "和国": "日本", "大和国": "日本", "东京当局": "日本",
    "大韩民国": "韩国", "南韩": "韩国", "韩方": "韩国", "首尔当局": "韩国",
    "朝鲜民主主义人民共和国": "朝鲜", "北韩": "朝鲜", "平壤当局": "朝鲜",
    "大不列颠及北爱尔兰联合王国": "英国", "联合王国": "英国", "不列颠": "英国", "英格兰": "英国", "UK": "英国", "U.K.": "英国",
    "United Kingdom": "英国", "伦敦当局": "英国",
    "法兰西共和国": "法国", "法兰西": "法国", "法方": "法国", "巴黎当局": "法国",
    "德意志联邦共和国": "德国", "德意志": "德国", "德方": "德国", "柏林当局": "德国",
    "加拿大全境": "加拿大", "加方": "加拿大", "渥太华当局": "加拿大",
    "澳洲": "澳大利亚", "澳方": "澳大利亚", "堪培拉当局": "澳大利亚",
    "中东": "中东地区", "欧盟": "欧洲联盟", "欧洲": "欧洲地区", "东南亚": "东南亚地区", "非洲": "非洲地区", "南美": "南美洲",
    "北美": "北美洲", "亚太": "亚太地区", "南极": "南极地区", "北极": "北极地区",
}
COUNTRIES = [
    "中国", "美国", "日本", "韩国", "朝鲜", "俄罗斯", "英国", "法国", "德国", "加拿大", "澳大利亚", "印度", "巴基斯坦",
    "印度尼西亚", "越南", "菲律宾", "泰国", "新加坡", "马来西亚", "意大利", "荷兰", "西班牙", "以色列", "沙特", "阿联酋",
]
NON_PLACE_WORDS = ["国会", "议会", "内阁", "政府", "首相府", "外交部", "内阁府", "议员"]
DOMESTIC_SUFFIXES = ["省", "市", "县", "区", "自治州", "自治县"]

# Dates --------------------------------------------------------------------------------------
VAGUE_DATE_WORDS = [
    "昨天", "昨日", "今天", "今日", "明天", "明日", "上月", "本月", "去年", "今年", "明年", "近期", "近段时间", "最近", "近日",
]
VAGUE_DATE_WORDS_WIDE = [*VAGUE_DATE_WORDS, "不久前", "日前", "即将到来"]
RECENT_DAYS_BACK = 3
PAST_DAYS_BACK = 7
UPCOMING_DAYS_AHEAD = 3
MID_AUTUMN = (9, 17)
CHINESE_DAYS = [
    "一", "二", "三", "四", "五", "六", "七", "八", "九", "十", "十一", "十二", "十三", "十四", "十五", "十六", "十七", "十八",
    "十九", "二十", "二十一", "二十二", "二十三", "二十四", "二十五", "二十六", "二十七", "二十八", "二十九", "三十", "三十一",
]
DAY_PARTS = ["上午", "下午", "晚间", "晚上", "晚", "清晨", "早上", "中午", "傍晚", "凌晨", "夜间", "深夜"]
TEN_DAY_PARTS = {"上旬": 5, "中旬": 15, "下旬": 25, "中下旬": 20, "中上旬": 10}

# Images -------------------------------------------------------------------------------------
IMAGE_TYPES = {
    "image/jpeg": "jpg", "image/png": "png", "image/gif": "gif", "image/bmp": "bmp", "image/webp": "webp",
    "image/tiff": "tiff", "image/x-icon": "ico",
}
