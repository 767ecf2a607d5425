"""Closed vocabularies and cue words. These are fixed values: results depend on them as they stand."""

# Entity types, their aliases and their specificity.
ENTITY_TYPES = ("character", "group", "organization", "location", "object", "concept", "occasion")
ENTITY_TYPE_ALIASES = {
    "world_rule_or_concept": "concept", "world_rule": "concept", "worldbuilding_concept": "concept", "scientific_concept": "concept",
    "event_or_disaster": "occasion", "event": "occasion", "disaster": "occasion", "operation": "occasion", "activity": "occasion",
    "technology": "concept", "technology_or_facility": "object", "facility": "location", "device": "object", "vehicle": "object",
    "machine": "object", "document": "object", "media": "object", "media_or_document": "object", "time": "concept",
    "deadline": "concept", "time_or_deadline": "concept",
}
ENTITY_SPECIFICITY = {"character": 6, "organization": 5, "group": 4, "location": 4, "object": 3, "occasion": 3, "concept": 1}
ENTITY_PRIORITY = ("character", "group", "organization", "object", "location", "occasion", "concept")

# Scene tags and surfaces that are not tracked.
SCENE_TAGS = ("background_element", "atmosphere", "illustrative_example", "generic_activity", "minor_visual_detail", "other")
UNTRACKED_SURFACES = ("人", "脑", "大脑", "脑子", "身体", "人体", "这", "这个", "这个世界", "这儿", "这里", "那", "那个", "那里", "那儿", "这根线", "这条线")
BODY_SURFACES = ("脑", "大脑", "脑子", "身体", "人体")
DEICTIC_ZH = ("这", "这个", "这儿", "这里", "那", "那个", "那儿", "那里", "他", "她", "它", "他们", "她们", "它们")
DEICTIC_EN = ("this", "that", "here", "there", "he", "she", "it", "they")
BACKGROUND_SURFACES = ("乌鸦", "水管", "积水", "巴士", "太阳", "杂草", "弹痕", "残垣断壁", "残破民用建筑", "超市栅栏门", "六层建筑", "老旧歪斜的摄像头")
OCCASION_SURFACES = ("山火", "旱灾", "一个物种的灭绝", "物种的灭绝", "一座城市的消失", "城市的消失", "视频录制", "录制")
COUNTDOWN_TERMS = ("氦闪", "危机", "灾难", "事件", "事故", "计划", "行动", "工程", "任务")
OCCASION_LONG_SIGNALS = ("计划", "行动", "工程", "会议", "实验", "事故", "灾难", "危机", "项目", "任务")
OCCASION_SHORT_SIGNALS = ("氦闪", "事件", "事故", "灾难", "危机")

SUN_NAMES = ("太阳危机", "太阳氦闪")
BACKGROUND_PARTS = ("弹痕", "残垣", "杂草", "积水", "水管", "巴士", "建筑", "栅栏门")
LISTED_DISASTERS = ("山火", "旱灾", "物种", "城市")
LISTING_WORDS = ("一场", "一次", "一个", "一座", "，", "、")
EXAMPLE_DISASTERS = ("山火", "旱灾", "灭绝", "消失")
TRACKED_WORDS = ("named", "trackable", "recurring", "central", "planned")
ATMOSPHERE_WORDS = ("atmosphere", "mood")
ANIMAL_WORDS = ("animal", "creature", "wildlife")
SCENERY_WORDS = ("ruin", "wreckage", "debris", "environment", "scenery", "visual detail")
SCENERY_PARTS = ("残垣", "弹痕", "废墟", "杂草", "积水")

# Relation types.
DURABLE_RELATIONS = (
    "ally", "alliance", "enemy", "hostile_to", "rival", "kinship", "family", "parent_of", "child_of", "sibling_of", "spouse_of",
    "romantic_partner", "friend", "trusts", "distrusts", "mentor", "mentorship", "mentor_of", "teacher_of", "instructor_of",
    "student_of", "trainee_of", "apprentice_of", "teammate", "teammate_of", "mission_partner", "pilot_partner", "comrade",
    "comrade_of", "leader_of", "subordinate_of", "member_of", "belongs_to", "owns", "owned_by", "custodian_of", "custody",
    "guardian", "guardian_of", "ward_of", "care_commitment_to", "care_responsibility_for", "guidance_responsibility_for",
    "protective_responsibility_for", "protected_by", "protects", "responsible_for", "duty_to", "affiliated_with", "works_for",
    "commands", "reports_to", "dependent_on", "long_term_dependency",
)
RELATION_ALIASES = {
    "ally": "alliance", "mentor": "mentor_of", "mentorship": "mentor_of", "teacher": "mentor_of", "teacher_of": "mentor_of",
    "instructor": "mentor_of", "instructor_of": "mentor_of", "student": "student_of", "trainee": "student_of",
    "trainee_of": "student_of", "apprentice": "student_of", "apprentice_of": "student_of", "guardian": "guardian_of",
    "custodian": "custodian_of", "care_commitment": "care_commitment_to", "care_commitment_for": "care_commitment_to",
    "care_responsibility": "care_responsibility_for", "protective_responsibility": "protective_responsibility_for",
    "team_mate": "teammate", "teammates": "teammate", "teammate_of": "teammate", "mission_partners": "mission_partner",
    "pilot_partners": "pilot_partner", "comrades": "comrade", "comrade_of": "comrade", "romantic_bond": "romantic_partner",
}
INVERSE_RELATIONS = {
    "ward_of": "guardian_of", "student_of": "mentor_of", "trainee_of": "mentor_of", "apprentice_of": "mentor_of",
    "child_of": "parent_of", "owned_by": "owns", "protected_by": "protects", "subordinate_of": "leader_of",
}
UNDIRECTED_RELATIONS = (
    "alliance", "enemy", "rival", "kinship", "family", "sibling_of", "spouse_of", "romantic_partner", "friend", "teammate",
    "mission_partner", "pilot_partner", "comrade", "affiliated_with",
)
MOMENTARY_RELATIONS = (
    "address", "addresses", "analyzes", "analyzing", "analyzes_brainwave_of", "review", "reviews", "reviewing", "discuss",
    "discusses", "demonstrate", "demonstrates", "demonstrator_to_subject", "demonstrator-to-subject", "uses_as_model",
    "uses_or_interacts_with", "speaks_to", "speaking_to", "observes", "looks_at", "connected_to", "displayed_on", "part_of",
)
CARE_LANGUAGE = ("照顾", "看护", "照看", "关照", "保护", "take care", "look after", "care for", "protect")
GUARDIAN_LANGUAGE = ("监护", "法定监护", "监护人", "被监护", "抚养权", "guardian", "legal guardian", "ward", "custody", "custodian")
MENTOR_LANGUAGE = ("导师", "老师", "教师", "教官", "师父", "师傅", "徒弟", "学生", "学员", "mentor", "teacher", "instructor", "student", "trainee", "apprentice")

# Temporal scopes of memories.
TEMPORAL_SCOPES = ("temporal_episode", "atemporal_fact", "durable_state", "uncertain")
TIME_BOUND_TYPES = ("action", "dialogue", "decision", "knowledge_transfer", "relationship_change", "state_change")
ATEMPORAL_TYPES = ("setting", "observation")
DURABLE_TYPES = ("state", "durable_state", "relationship")
ATEMPORAL_WORDS = (
    "本质", "原理", "规则", "技术", "定义", "意味着", "说明", "存在", "是一个", "是一种", "可以", "能够", "用于", "禁止", "不是",
    "身份", "属于", "位于", "由", "由此", "系统", "计划", "工程", "危机", "concept", "principle", "technology", "rule", "exists",
)
DURABLE_WORDS = (
    "通过", "负责", "担任", "处于", "保持", "拥有", "掌握", "知道", "认为", "相信", "承诺", "照顾", "关系", "身份", "状态", "禁止",
    "准备", "即将", "计划", "has", "knows", "believes", "responsible", "status",
)
EPISODE_WORDS = (
    "进入", "离开", "走", "飞", "驾驶", "打开", "关闭", "启动", "操作", "询问", "回答", "说", "告诉", "提醒", "回忆", "看到", "望向",
    "开始", "继续", "随后", "接着", "先", "后", "最终", "起飞", "降落", "爆发", "融化", "坠毁", "arrives", "enters", "leaves",
    "says", "asks", "starts",
)

# Cues of the scene classifier.
VISUAL_CUES = ("镜头", "画面", "特效", "CG", "全景", "远景", "近景", "航拍", "俯瞰", "闪回", "蒙太奇", "切至", "转场", "字幕", "屏幕上", "新闻画面", "影像")
CG_CUES = ("爆炸", "坍塌", "碎片", "火光", "火球", "冲击波", "海啸", "地震", "山火", "旱灾", "灾难", "太空", "地球", "月球", "发动机", "飞船")
CONFLICT_CUES = ("决定", "命令", "拒绝", "同意", "争执", "冲突", "质问", "威胁", "谈判", "追问", "为什么", "必须", "不能", "逃避", "禁止", "救", "杀", "牺牲")
ACTION_CUES = ("走", "跑", "冲", "拿", "打开", "关闭", "启动", "按下", "检查", "扫描", "连接", "抓", "推", "打", "进入", "离开", "举起", "递给")
EXPOSITION_CUES = ("理论上", "本质上", "意味着", "说明", "介绍", "解释", "技术", "规则", "计划", "系统", "文明")
CHARACTER_CUES = ("科学家", "受试者", "科研人员", "工作人员", "士兵", "警卫", "孩子", "男人", "女人", "老人", "父亲", "母亲", "老师", "学生")
MONTAGE_CUES = ("蒙太奇", "转场", "切至", "闪回", "字幕")

# Conversation statements.
STATEMENT_CUES = {
    "negative": ("不要", "别", "不能", "避免", "不该", "不应该"),
    "writing": ("写", "设定", "角色", "口吻", "风格", "当成", "成为"),
    "rejected": ("否掉", "不要了", "废弃", "不采用", "删掉", "算了"),
    "decided": ("记住", "确定", "确认", "就设定为", "作为正式设定"),
    "wished": ("我希望", "我想", "偏好", "更喜欢", "最好"),
    "style": ("风格", "口吻", "对白", "叙述", "节奏", "语气"),
    "asked": ("是不是", "如何", "怎么处理", "要不要"),
}
QUOTED = "[《“\"]([^”\"]{1,20})[”\"]"
SUBJECT_FRAMES = ("把{name}写成", "写{name}时", "{name}不要", "{name}不应该", "{name}应该")
NO_SPEAKER = ("注释", "备注", "（", "(", "，", "。", "、")
SUBJECT_STOPWORDS = ("不要", "不能", "应该", "写成", "角色", "设定", "用户", "明确", "希望", "作为", "正式")

# Context items.
STATUS_RANKS = {"canonical": 5, "active": 4, "tentative": 2, "extracted": 1, "superseded": -1, "rejected": -2, "archived": -3, "deleted": -4}
SOURCE_BONUS = {"conversation": 0.4, "narrative_artifact": 0.35, "external_reference": 0.25, "simulation": 0.1}
SOURCE_TYPES = ("conversation", "narrative_artifact", "external_reference", "simulation")
HISTORY_EVENTS = ("ADD", "UPDATE", "DELETE", "PATCH", "PROMOTE", "SUPERSEDE", "REJECT", "ARCHIVE", "LINK")
LINK_TYPES = ("promotes", "supersedes", "supports", "contradicts", "constrains", "derived_from", "cites")
PATCH_TYPES = ("add", "revise", "constrain", "deprecate", "rename", "merge")
COMPATIBLE_FACTS = ("fact", "state", "character_profile", "world_bible")
CONTRADICTION_WORDS = ("冲突", "矛盾", "contradict", "conflict")

# Query keywords.
SPLIT_WORDS = ("和", "与", "跟", "及", "以及", "还有", "关于", "有关", "之间", "是什么", "什么", "哪些", "哪位", "是谁", "如何", "怎么", "为什么", "请", "告诉我", "说明", "解释")
QUERY_STOPWORDS = ("关系", "关联", "相关", "资料", "信息", "内容", "外部", "参考", "reference", "refs", "what", "who", "when", "where", "why", "how")
QUERY_FILLERS = ("什么", "哪些", "如何", "怎么", "为什么", "是否", "有没有", "请问")
KEYWORD_SUFFIXES = ("方式", "情况", "信息", "内容", "资料")
KEYWORD_CUES = (
    ("关系", ("关系", "关联")), ("关联", ("关联",)), ("相关", ("相关",)), ("指导", ("指导", "训练")), ("训练", ("训练",)),
    ("加入", ("加入", "组织关系")), ("属于", ("所属",)), ("身份", ("身份",)), ("性格", ("性格", "人物属性")), ("属性", ("属性",)),
    ("设定", ("设定",)), ("时间", ("时间", "时间线")), ("时间线", ("时间线",)), ("什么时候", ("时间", "时间线")),
    ("哪年", ("时间", "时间线")), ("何时", ("时间", "时间线")), ("先后", ("时间顺序",)), ("导致", ("因果",)), ("原因", ("因果",)),
    ("地点", ("地点",)), ("位置", ("地点",)), ("组织", ("组织关系",)), ("阵营", ("组织关系",)),
)
KEYWORD_CUES_EN = (
    ("relationship", ("relationship",)), ("relation", ("relationship",)), ("timeline", ("timeline",)), ("when", ("timeline",)),
    ("where", ("location",)), ("identity", ("identity",)), ("profile", ("profile",)), ("trait", ("trait",)),
)

# Weights of vector namespaces when no vectors are at hand, and the evidence budgets.
NAMESPACE_WEIGHTS = {
    "source_local_entities": 0.35, "atomic_facts": 0.34, "source_local_relationships": 0.28, "entity_properties": 0.24,
    "entity_clusters": 0.18, "pseudo_relationships": 0.16, "chunks": 0.1,
}
BUDGETS = {
    "compact": {"top_k": 4, "multiplier": 2, "facts": 4, "properties": 3, "relations": 3, "entities": 4, "chunks": 2, "insights": 2, "notes": 2, "fact_binding": 3, "property_binding": 2},
    "standard": {"top_k": 8, "multiplier": 3, "facts": 8, "properties": 6, "relations": 6, "entities": 6, "chunks": 4, "insights": 4, "notes": 4, "fact_binding": 4, "property_binding": 3},
    "deep": {"top_k": 16, "multiplier": 5, "facts": 16, "properties": 12, "relations": 10, "entities": 12, "chunks": 8, "insights": 8, "notes": 8, "fact_binding": 6, "property_binding": 4},
}

# Negation, relations that say there is none, name titles.
NEGATIONS = ("不", "不是", "没有", "不能", "不可", "不要", "avoid", "not", "never", "no")
NO_RELATION = (
    "未提及", "没有提及", "未说明", "没有说明", "无直接关系", "不存在直接关系", "没有直接关系", "无明确关系", "没有明确关系", "无关系",
    "not mentioned", "not state", "not stated", "no direct relation", "no direct relationship", "no relationship",
)
TITLES = ("Dr.", "Dr", "Mr.", "Mr", "Mrs.", "Mrs", "Ms.", "Ms")
ROLE_LEADS = ("为首的", "那位", "这位", "一个", "一位", "几位", "多位", "那个", "这个")
ROLE_NAMES = ("印度科学家", "科学家", "科研人员", "研究人员")
ROLE_SUFFIXES = ("人员", "观众", "设备")

# Terms of the social model.
SAFETY_TERMS = ("危险", "风险", "安全", "稳", "慢", "低空", "告警", "警报", "高度", "姿态", "返航", "飞行")
CARE_TERMS = ("照看", "照顾", "关切", "保护", "提醒", "劝", "承诺", "带着", "后辈", "关心")
RESISTANCE_TERMS = ("抗拒", "不愿", "拒绝", "回避", "压抑", "厌", "地球", "不美好", "别管", "沉默")
RELATION_TERMS = ("关系", "照看", "提醒", "承诺", "同伴")
THERAPY_PHRASES = ("别跟地球赌气", "跟地球赌气", "和自己和解", "你是在逃避", "不要逃避", "放下过去", "放下执念")
FORMAL_ROLES = ("监护人", "法定监护", "亲属", "叔叔", "舅舅", "教官", "老师", "上级", "下属", "指挥官", "正式飞行员", "正式航天员", "老兵")
FUTURE_LEAKS = ("后续剧情", "后面的场景", "下一场", "未来会", "后来会", "目标场景原文")
EFFECTS = {
    "risky_operation": {"scene_pressure": 0.25, "safety": -0.2, "relationship_tension": 0.15},
    "safety_correction": {"safety": 0.25, "relationship_tension": 0.1, "care_visible": 0.15},
    "minimal_compliance": {"safety": 0.1, "resistance": -0.05, "relationship_tension": -0.05},
    "value_resistance": {"resistance": 0.2, "relationship_tension": 0.15},
    "deflection": {"resistance": 0.1, "information_clarity": -0.1},
    "care_reframe": {"care_visible": 0.25, "relationship_tension": -0.05},
    "information_probe": {"information_clarity": 0.15, "relationship_tension": 0.05},
    "silence_or_withholding": {"information_clarity": -0.1, "scene_pressure": 0.1},
    "physical_reaction": {"scene_pressure": 0.1, "character_pressure_visible": 0.15},
}
#: What opens a beat and what answers it, by the kind of pressure.
BEAT_OPENERS = {
    "value_resistance": ("risky_operation", "value_resistance", "deflection", "physical_reaction"),
    "care_guidance": ("safety_correction", "care_reframe", "information_probe", "physical_reaction"),
    "safety_correction": ("safety_correction", "care_reframe", "physical_reaction"),
}
BEAT_ANSWERS = {
    "value_resistance": ("safety_correction", "care_reframe", "minimal_compliance", "physical_reaction"),
    "care_guidance": ("minimal_compliance", "value_resistance", "deflection", "physical_reaction"),
    "safety_correction": ("minimal_compliance", "value_resistance", "deflection", "physical_reaction"),
}
BEAT_ANSWERS_ELSE = ("information_probe", "silence_or_withholding", "physical_reaction")
PROBLEM_FUNCTIONS = ("risky_operation", "safety_correction", "care_guidance", "value_resistance")

# Story time.
EVENT_MODES = ("present_scene", "past_recalled", "future_anticipated", "habitual", "hypothetical", "uncertain")
EVENT_TRACKS = ("plot", "context", "forecast", "memory", "hypothetical", "unknown")
GRANULARITIES = ("absolute_date", "year", "season", "day", "time_of_day", "scene_relative", "event_relative", "unknown")
TEMPORAL_RELATIONS = ("before", "after", "overlaps", "same_time", "contains", "causes", "anticipates", "claims", "reveals_past", "uncertain")
ENVIRONMENT_TERMS = ("太阳", "恒星", "冰川", "海啸", "山火", "旱灾", "灾难", "城市", "物种", "环境", "地球", "海洋", "风暴", "太阳风暴")
ENVIRONMENT_CONTEXT = (
    "蒙太奇", "画面", "字卡", "冰川", "海啸", "太阳", "恒星", "日珥", "黑子", "膨胀", "灾难", "山火", "旱灾", "物种", "城市", "爆炸",
    "枪战", "硝烟", "废墟", "环境", "世界状态",
)
