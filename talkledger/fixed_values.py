"""Values that decide results and therefore have to be what they are.

Fixed values: word lists, character sets, patterns, limits and the token, keyword and
source tables of the built-in rules. Rule titles, descriptions and prompt wording are
parameters of the operators that use them.
"""

# --- recogniser text ------------------------------------------------------------
TAG_PATTERN = r"<\|[^|]+\|>"
EMOJI_PATTERN = r"[\x{1F300}-\x{1F9FF}\x{2600}-\x{27BF}\x{1F600}-\x{1F64F}\x{1F680}-\x{1F6FF}]+"
CJK_PUNCTUATION = "。，、！？；："
FULL_STOP = "。"

# --- noise segments --------------------------------------------------------------
NOISE_PUNCTUATION = "。，、！？；：.!?;,: "
NOISE_WORDS_CN = (
    "嗯", "啊", "哦", "呃", "唔", "嘿", "哈", "呵", "噢", "喔", "诶", "哎", "唉", "呀",
    "吧", "呢", "嘛", "咯", "喽", "哇", "嗯嗯", "啊啊", "哦哦",
)
NOISE_WORDS_EN = (
    "the", "a", "an", "um", "uh", "yeah", "yes", "no", "oh", "ah", "er", "hmm", "hm", "mm",
    "mhm", "ok", "okay", "the the", "the yeah", "a a", "um um", "uh uh",
)

# --- normaliser ------------------------------------------------------------------
NOISE_PHRASE_WORDS = (
    "the", "a", "an", "yeah", "yes", "no", "ok", "okay", "um", "uh", "oh", "ah", "er", "hmm",
    "hm", "mm",
)
FILLERS = ("嗯", "啊", "哦", "呃", "唔", "嘿", "哈", "呵", "噢", "喔", "诶", "哎", "唉", "呀")
REPEATED_WORDS = (
    "那个", "这个", "就是", "然后", "所以", "但是", "因为", "可能", "应该", "终于", "了解",
    "不好意思", "嗯", "啊", "哦", "呃",
)
CN_DIGITS = "零〇一二三四五六七八九"
ARABIC_DIGITS = "00123456789"
CN_YEAR_DIGITS = r"[一二三四五六七八九][零〇][一二三四五六七八九零〇][一二三四五六七八九零〇]"
YEAR_MARK = "年"
BLANK_PUNCTUATION = "，。、！？；：,.!?;: "

# --- sentences and chunks --------------------------------------------------------
SENTENCE_MARKS = "。！？；\n"
CHUNK_MARKS = "。！？.!?；;\n"
SPLIT_MARKS = "。！？；，、：.!?;,:"
UNSCORED_MARKS = "。！？；，、：“”‘’（）《》【】…—·\n.!?;,:\"'()[]"

# --- limits ----------------------------------------------------------------------
CHUNK_CHARS = 800
CHUNK_OVERLAP = 50
SMOOTH_MS = 1500
MERGE_GAP_MS = 500
VIEW_GAP_MS = 30_000
ENTRY_MERGE_MS = 2000
DEDUP_WINDOW_MS = 30_000
AUDIT_CHUNK_CHARS = 4000
BATCH_ROWS = 15
BATCH_CHARS = 800
MAX_TEXT_CHARS = 50_000
EVALUATION_CHUNK_CHARS = 6000
OCR_CONFIDENCE = 0.6
OCR_MIN_LENGTH = 2
OCR_MARGIN_MS = 5000
EVIDENCE_MARGIN_MS = 10_000
VIOLATION_CONFIDENCE = 0.7
TRUSTED_CONFIDENCE = 0.95
FACE_MISSING_MS = 10_000
FRAME_MAX = 500
LONG_SEGMENT_MS = 15_000
SPEAKER_WINDOW_MS = 1500
SPEAKER_STEP_MS = 750
SPEAKER_MIN_WINDOW_MS = 500
SPEAKER_LONG_MS = 3000
SPEAKER_MAX_WINDOWS = 500
OUTPUT_TOKENS = 4096
FAILED_SUMMARY_CHARS = 500
EXAMPLES_PER_PROMPT = 5
CONTEXT_CHARS = 80
CONTEXT_ENTRIES = 3
DEFAULT_CUE_MS = 5000
QUIET_MS = 500
VIDEO_SUFFIXES = (".mp4", ".avi", ".mov", ".mkv", ".flv", ".wmv")
SEVERITY_POINTS = {"high": 15.0, "medium": 8.0}
OTHER_POINTS = 3.0
SEVERITIES = ("high", "medium", "low")
RESPONSE_WRAPPERS = ("violations", "results", "items", "data")

# --- rule sheets -----------------------------------------------------------------
SHEET_HEADER_WORDS = ("必备要素", "检查", "标准", "序号", "注：")
SHEET_STOP_WORD = "存在的问题"
SHEET_SKIPPED_CELLS = ("合格", "不涉及", "None", "")
SHEET_ENCODINGS = ("utf-8-sig", "utf-8", "gbk", "gb18030")

# --- built-in rules: (id, category, check mode, evidence sources, severity) -------
BUILT_IN_RULES = (
    (1, "behavioral", "semantic", ("transcript",), "medium"),
    (2, "behavioral", "semantic", ("transcript",), "medium"),
    (3, "visual_check", "visual", ("ocr",), "medium"),
    (4, "behavioral", "semantic", ("transcript",), "high"),
    (5, "forbidden_phrase", "semantic", ("transcript", "ocr"), "high"),
    (6, "forbidden_phrase", "semantic", ("transcript",), "high"),
    (7, "visual_check", "visual", ("ocr",), "low"),
    (8, "forbidden_phrase", "semantic", ("transcript", "ocr"), "high"),
    (9, "forbidden_phrase", "semantic", ("transcript", "ocr"), "high"),
    (10, "behavioral", "semantic", ("transcript",), "low"),
    (11, "behavioral", "semantic", ("transcript",), "medium"),
    (12, "forbidden_phrase", "exact", ("transcript", "ocr"), "high"),
    (13, "forbidden_phrase", "exact", ("transcript", "ocr"), "high"),
)
BUILT_IN_KEYWORDS = {
    5: ("保证收益", "稳赚", "只赚不赔", "翻倍", "年化收益率"),
    6: ("垃圾公司", "骗人", "倒闭"),
    9: ("行业第一", "最大", "最强", "最好"),
    12: ("存取", "利息", "本金", "存款", "储蓄", "存钱", "取钱", "利率"),
    13: ("保种水平", "保证水平", "零风险", "无风险", "绝对安全", "百分百", "100%赔付"),
}
MATCH_TOKENS = {
    1: ("如实告知", "告知义务", "健康状况"),
    2: ("风险提示", "免责条款"),
    3: ("条款展示", "条款", "统一印制", "宣传材料"),
    4: ("全程双录", "双录", "录音录像", "摄录"),
    5: ("夸大收益", "保证收益", "承诺收益", "变相夸大"),
    6: ("诋毁同业", "诋毁", "贬低"),
    7: ("信息披露", "课件文件名", "定稿日期"),
    8: ("虚假陈述", "误导宣传", "误导", "不实对比"),
    9: ("保单利益", "分红", "经营成果", "万能险", "投资收益"),
    10: ("讲师资质", "从业资格", "认证资格", "师资", "资料归档"),
    11: ("适当性", "搭售", "主讲人"),
    12: ("存取", "利息", "本金", "混淆", "比率简单对比"),
    13: ("保种水平", "保证水平", "零风险", "不允许出现"),
}

# --- formats of produced texts ----------------------------------------------------
FALLBACK_TITLE = "规则%d"
EXAMPLE_FORMAT = "规则%d(%s...): %s"
EXAMPLE_TITLE_CHARS = 20
NO_FINDING_SUMMARY = "审核完成，未发现违规内容。"
COUNT_SUMMARY = "发现 %d 条违规（高风险 %d 条，中风险 %d 条，低风险 %d 条）。"
EXACT_REASON = "精确匹配检测到禁止用语「%s」"
SOUND_REASON = "拼音匹配检测到禁止用语同音字（对应「%s」）"
