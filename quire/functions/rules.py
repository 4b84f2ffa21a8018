"""Word lists, patterns, weights and thresholds that results depend on."""

# Placeholder keywords of the quality rules.
PLACEHOLDERS = [
    "待补充", "待分析", "待填写", "待生成", "待完善", "书中未提供", "书中未提供具体", "TBD", "TODO", "N/A", "NULL", "未能正确解析", "解析异常", "Unknown",
    "内容待补充", "分析待补充", "（此处内容由 LLM 生成）", "（内容由模型生成）", "简介待补充", "待补充具体", "书中未涉及此项内容", "书中未涉及此项", "此章节省略",
    "中间章节省略", "实际输出时请完整复制", "具体内容已省略", "此处省略",
]

# Template phrases of the quality rules.
TEMPLATES = [
    "本章探讨了书中的核心议题", "本章分析了书中的核心议题", "本章讨论了书中的核心议题", "本章阐述了书中的核心议题", "作者通过逻辑推理展开论述", "通过逻辑推理展开论述",
    "进行系统性阐述", "提供了新的分析框架", "提供了新的解决方案", "作者在这一部分", "本章主要讨论", "本章主要分析", "本章主要阐述", "对书中的核心概念进行",
    "对书中的关键概念进行", "对书中的重要概念进行", "本书的核心观点", "本书的主要观点", "本书的关键观点", "书中探讨了", "书中分析了", "书中阐述了",
    "章节内容未能正确解析", "可能需要重新处理本书",
]

# Keywords by which a chapter counts as a placeholder, in order of precedence.
CHAPTER_PLACEHOLDERS = ["N/A", "NULL", "TBD", "TODO", "书中未涉及此项内容", "书中未涉及此项", "此章节省略", "中间章节省略", "具体内容已省略", "此处省略"]

# Merged chapter numbers, and the form of a logic statement.
MERGED = [r"\d+-\d+", r"第\d+-\d+章", r"\d+至\d+", r"\d+～\d+", r"章节\s*\d+-\d+"]
LOGIC = r"(前提假设|推理链条|核心结论).*[:：].*"

# Issue texts that block, required fields, and thresholds.
BLOCKING = ["占位符污染", "章节合并", "空洞章节", "模板化内容", "章节缺失"]
TOP_FIELDS = ["metadata", "time_background", "critical_analysis", "chapters", "core_concepts", "key_insights", "key_cases", "key_quotes"]
METADATA_FIELDS = ["title", "author", "author_intro", "discipline"]
TIME_FIELDS = ["macro_background", "micro_background", "core_contradiction"]
LEARNING_STAGES = ["beginner", "intermediate", "advanced", "practice"]
MIN_CHAPTERS, MIN_CONCEPTS, MIN_QUOTES, MIN_INSIGHTS, MIN_CASES, MIN_CONTENT, MIN_DEFINITION = 5, 3, 1, 2, 1, 50, 30

# Keywords of messages about an exhausted quota, compared in lower case.
QUOTA = ["daily_limit_exceeded", "rate limit", "quota", "limit exceeded", "too many requests", "usage limit", "credit", "billing", "insufficient_quota", "免费额度", "额度耗尽"]

# What cleaning a text rewrites, in this order. What takes in the start of a line is tried there only.
CLEANING = [
    (r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""),
    (r"\r\n|\r", "\n"),
    (r"\n{3,}", "\n\n"),
    (r"(?md)^[^\n]*·(?U:\s)*第(?U:\s)*(?U:\d)+(?U:\s)*页[^\n]*\n", ""),
    (r"(?imd)^[^\n]*chapter(?U:\s)+(?U:\d)+[^\n]*\n", ""),
    (r"ISBN[-\s]?\d[\d\sX-]{9,}", ""),
    (r"(?i)Copyright © \d{4}[^\n]*", ""),
    (r"https?://(?:[a-zA-Z0-9$-_@.&+!*\\(),]|%[0-9a-fA-F]{2})+", ""),
]

# Headings at which an overlapping chunk may end, the last that is found going first.
CHUNK_HEADINGS = [r"(?i)\n#{1,3}(?U:\s)+", r"(?i)\n第 [一二三四五六七八九十\p{Nd}]+[章节]", r"(?i)\nChapter(?U:\s)+(?U:\d)+", r"(?i)\nPART(?U:\s)+[IVX\p{Nd}]+"]

# Words that the tokenizer leaves out.
STOPWORDS = ["the", "and", "of", "to", "in", "for", "on", "with", "by", "a", "an"]

# Keywords of each kind of book, kinds in order of precedence.
BOOK_TYPES = {
    "academic": ["研究", "理论", "分析", "实证", "假设", "论文", "文献综述", "方法论"],
    "business": ["商业模式", "战略", "市场", "客户", "产品", "增长", "盈利", "竞争优势"],
    "fiction": ["他", "她", "说道", "心想", "走进", "房间", "突然", "于是"],
    "technical": ["代码", "编程", "算法", "系统", "架构", "数据库", "接口", "实现"],
    "philosophy": ["思想", "哲学", "存在", "本质", "意义", "价值", "理性", "意识"],
    "history": ["年", "世纪", "朝代", "战争", "帝国", "王朝", "历史", "时代"],
}

# Size classes (characters below which) and their strategies.
SIZE_CLASSES = [("short", 30_000), ("medium", 100_000), ("long", 300_000), ("extra_long", None)]
SIZE_STRATEGIES = [
    # size, chunk_strategy, max_chunks, parallel_books, parallel_chunks, chunk_size, quality_level, max_tokens, temperature, timeout_multiplier
    ("short", "single", 1, 4, 1, 30000, "fast", 16384, 0.3, 1.0),
    ("medium", "semantic", 4, 3, 2, 25000, "standard", 16384, 0.4, 1.2),
    ("long", "semantic", 10, 2, 3, 30000, "high", 24576, 0.5, 1.5),
    ("extra_long", "chapter", 20, 1, 4, 35000, "high", 24576, 0.5, 2.0),
]

# Extraction engines in order: least and most characters, quality, speed, disciplines, hypergraph.
ENGINES = [
    ("GraphRAG", 100_000, None, "excellent", "slow", ["政治学", "历史学", "社会学"], False),
    ("LightRAG", 10_000, 100_000, "good", "fast", ["经济学", "管理学", "心理学"], False),
    ("Hyper-RAG", 20_000, 300_000, "excellent", "medium", ["哲学", "逻辑学", "科学", "社会学"], False),
    ("KG-Gen", 0, 50_000, "basic", "fast", [], False),
    ("HypergraphRAG", 20_000, 200_000, "excellent", "medium", ["科学", "复杂性研究"], True),
    ("iText2KG", 0, 30_000, "basic", "fast", [], False),
    ("Cog-RAG", 30_000, 150_000, "excellent", "medium", ["哲学", "认知科学"], False),
]

# Entity dictionary by type.
ENTITIES = {
    "人物": "基辛格 霍布斯 洛克 马基雅维利 马克思 恩格斯 列宁 毛泽东 邓小平 周恩来 孔子 孟子 老子 孙子 亚里士多德 柏拉图 苏格拉底 尼采 康德 黑格尔 罗尔斯 哈耶克 韦伯 杜威 熊彼特".split(),
    "著作": "利维坦 君主论 政府论 世界秩序 大外交 文明的冲突 论中国 正义论 自由秩序 乌托邦 太阳城 理想国 政治学 尼各马可伦理学 纯粹理性批判 历史的终结 开放社会及其敌人".split(),
    "概念": "国家 权力 主权 自由 民主 法治 均势 威斯特伐利亚体系 天下秩序 现实主义 自由主义 建构主义 马克思主义 功利主义 契约论 自然法 社会契约 人权 公民权利 政治权利".split(),
    "组织": "联合国 欧盟 北约 美国国会 国务院 外交部 中央政治局 全国人大 世界银行 IMF WTO".split(),
    "国家": "美国 中国 英国 法国 德国 俄罗斯 日本 印度 巴西 南非 澳大利亚 加拿大".split(),
    "事件": "威斯特伐利亚和约 维也纳会议 冷战 二战 一战 美国独立战争 法国大革命 俄国十月革命 中国改革开放 柏林墙倒塌 苏联解体".split(),
    "时期": "古代 中世纪 近代 现代 后现代 文艺复兴 启蒙时代 工业革命时期 信息时代".split(),
}

# Patterns of works and persons with their confidences, and that of dictionary terms.
WORK_PATTERN, WORK_CONFIDENCE = "《([^》]+)》", 0.90
PERSON_PATTERN, PERSON_CONFIDENCE = "([一-龥]{2,4})(说|认为|提出|指出|写道)", 0.80
TERM_CONFIDENCE = 0.95

# Field names and what they are renamed to.
FIELD_ALIASES = {
    "chapter_summaries": ["章节摘要", "章节概要", "章节分析", "章节内容", "chapter_summary", "chapter_summaries", "summaries"],
    "core_concepts": ["核心概念", "核心观念", "关键概念", "重要概念", "核心理论", "core_concepts", "concepts", "key_concepts"],
    "key_insights": ["关键洞见", "关键洞察", "核心洞见", "重要洞见", "核心观点", "key_insights", "insights", "key_ideas"],
    "key_cases": ["关键案例", "经典案例", "典型案例", "重要案例", "案例分析", "key_cases", "cases", "examples"],
    "golden_quotes": ["金句", "名言", "关键引用", "经典语句", "精彩段落", "golden_quotes", "quotes", "quotations", "key_quotes", "golden_sentences", "key_sentences"],
    "author_themes": ["作者思想", "作者观点", "author_themes"],
    "book_structure": ["书籍结构", "book_structure"],
    "argument_logic": ["论证逻辑", "argument_logic"],
    "development_path": ["发展脉络", "development_path"],
}
MANDATORY = {
    "chunk_analysis": [],
    "synthesis": ["metadata", "chapters", "core_concepts"],
    "synthesis_round_1": ["metadata"],
    "synthesis_round_2": ["chapters"],
    "synthesis_round_3": ["chapters"],
    "synthesis_round_4": ["chapters"],
    "synthesis_round_5": ["key_insights"],
}

# Weights of the relevance signals.
DIRECT_LINK, SOURCE_OVERLAP, ADAMIC_ADAR, TYPE_AFFINITY = 3.0, 4.0, 1.5, 1.0
# Title bonus of token search; weight of graph scores in the fusion.
TITLE_BONUS, GRAPH_WEIGHT = 2.0, 1.5

# Histogram bounds of request times, in seconds.
API_BUCKETS = [0.1, 0.5, 1.0, 2.0, 5.0, 10.0, 30.0, 60.0]

# Texts of a model's output that stand for nothing, and those that an axiom forbids.
OUTPUT_PLACEHOLDERS = ["待补充", "待分析", "待填写", "待完善", "待完成", "TBD", "TODO", "FIXME", "N/A", "暂无", "需要补充", "需要分析", "略", "无", "（待补充）", "（待分析）", "（略）"]
AXIOM_PLACEHOLDERS = ["待补充", "TBD", "TODO", "N/A", "NULL"]

# What a book's Markdown must have, and what it must not.
MARKDOWN_SECTIONS = ["时代背景", "章节结构总览", "核心概念", "关键洞见", "关键案例", "金句萃取", "批判性解读", "伦理边界", "学习路径", "关联书籍网络"]
MARKDOWN_FIELDS = ["title", "author", "discipline", "tags"]
MARKDOWN_PLACEHOLDERS = ["待补充", "待分析", "待填写", "待生成", "TBD", "TODO", "N/A", "NULL", "暂无", "（此处内容由 LLM 生成）", "（内容由模型生成）", "无法确定", "书中未提供", "完整内容未提供", "（完整内容未提供）"]
