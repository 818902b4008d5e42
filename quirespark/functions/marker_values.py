"""Fixed values of the evidence that a rendering must keep: patterns and word lists, without any logic."""

from __future__ import annotations

# Numbers, ranges, comparisons, units, citations, references and decades.
UNSIGNED = r"(?:\d+(?:,\d{3})*(?:\.\d+)?|\.\d+)(?:[eE][-+]?\d+)?"
SIGNED = rf"[-+−]?{UNSIGNED}"
NUMBER = rf"(?<![A-Za-z0-9_.])(?:(?<!\w)-|[+−])?{UNSIGNED}"
RANGE = rf"(?<![A-Za-z0-9_.-])({SIGNED})\s*(?:-|–|—|to|至|到)\s*({SIGNED})(?![A-Za-z0-9])"
TRANSITION = rf"(?:从|由)\s*({SIGNED})\s*(?:(?:mm|cm|m|s|h|%)(?:[·/](?:a|s|h)(?:[−-]?\d+)?)?\s*)?(?:增加|提高|降低|减少|升高|下降|加速)?(?:至|到)\s*({SIGNED})"
SIGN_COMPARISON = rf"(<=|>=|<|>|≤|≥)\s*({SIGNED})"
WORD_COMPARISON = rf"(no\s+less\s+than|no\s+more\s+than|at\s+least|at\s+most|greater\s+than|more\s+than|less\s+than|above|below|not\s+exceed(?:-\s*)?ing|exceed(?:-\s*)?ing|不少于|不低于|至少|不超过|不高于|至多|大于|高于|小于|低于|超过)\s*(?:提高|增加|减少|降低|为)?\s*({SIGNED})"
UNIT = r"(?<![A-Za-z'’])(?:%|°C|℃|k?Pa|MPa|kg|mg|μg|µg|ug|mm|cm|μm|µm|um|nm|mL|mmol/L|mol/L|Hz|m/s|min|h|s|K|L)(?![A-Za-z])"
CITATION = r"\[[0-9,;\s–—-]+\]|\([A-Z][^()]{0,80}?(?:19|20)\d{2}[a-z]?[^()]*\)|（[A-Z][^（）]{0,80}?(?:19|20)\d{2}[a-z]?[^（）]*）"
FIGURE_TABLE = r"(?i)(?:(?:Fig(?:ure)?|Table)\.?\s*[0-9]+[A-Za-z]?|[图表]\s*[0-9]+[A-Za-z]?)"
ENGLISH_DECADE = r"(?<![A-Za-z0-9])((?:1\d|20)\d0)s(?![A-Za-z0-9])"
ARABIC_DECADE = r"(?<!\d)(\d{1,2})\s*世纪\s*(\d{1,2})\s*年代"
WRITTEN_DECADE = r"([一二两三四五六七八九十]{1,3})世纪([一二两三四五六七八九十]{1,3})年代"
# Identifiers, whose numbers are none of the text.
SHORTHAND_LIST = r"(?i)(?<![A-Za-z0-9])[A-Za-z][A-Za-z0-9]*-\s*\d+(?:[\s,，、和及]*(?:(?:and|or)\b[\s,，、]*)?-\s*\d+)+"
COMPACT_IDENTIFIER = r"(?<![A-Za-z0-9])(?=[A-Za-z0-9./\s-]*[A-Za-z])(?=[A-Za-z0-9./\s-]*\d)[A-Za-z][A-Za-z0-9]*(?:[-/]\s*[A-Za-z0-9]+)+(?![A-Za-z0-9])"
SPACED_IDENTIFIER = r"\b[A-Za-z]{2,}\s+\d+(?:\s*/\s*\d+)+(?![A-Za-z0-9])"
CJK_IDENTIFIER = r"[㐀-鿿]{2,}-\d+(?=[（(][A-Za-z])"
GREEK_IDENTIFIER = r"[Ͱ-Ͽ]\d+(?:\s*/\s*[Ͱ-Ͽ]?\d+)*"
IDENTIFIERS = (SHORTHAND_LIST, COMPACT_IDENTIFIER, SPACED_IDENTIFIER, CJK_IDENTIFIER, GREEK_IDENTIFIER)
WORD_NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
CHINESE_DIGITS = {"一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
STATISTICS = {"mean": "mean|平均值?", "median": "median|中位数", "p": "p", "n": "n", "r2": "r2|r²", "ci": "ci", "or": "or", "hr": "hr"}
OPERATORS = {
    "<": "<", "<=": "<=", "≤": "<=", ">": ">", ">=": ">=", "≥": ">=",
    "no less than": ">=", "at least": ">=", "不少于": ">=", "不低于": ">=", "至少": ">=",
    "no more than": "<=", "at most": "<=", "不超过": "<=", "不高于": "<=", "至多": "<=", "not exceeding": "<=",
    "greater than": ">", "more than": ">", "above": ">", "exceeding": ">", "超过": ">", "大于": ">", "高于": ">",
    "less than": "<", "below": "<", "小于": "<", "低于": "<",
}
UNIT_FORMS = {"ug": "μg", "um": "μm", "µ": "μ", "℃": "°C"}
# Classes of words that a rendering must keep, English and Chinese.
DIRECTION = {
    "increase": r"\bincreas(?:e|ed|es|ing)\b|增加|增多|升高|上升|提高|增长|延长|更多",
    "decrease": r"\bdecreas(?:e|ed|es|ing)\b|减少|降低|下降",
    "higher": r"\bhigher\b|更高|较高|高于|越高",
    "lower": r"\blower\b|较?低|下(?:部|方)",
    "positive": r"\bpositiv(?:e|ely)\b|正相关|正向|阳性",
    "negative": r"\bnegativ(?:e|ely)\b|负相关|负向|阴性",
}
NEGATION = {
    "negation": r"\bnot\b(?!\s+only\b)|\bno\b|\bwithout\b|\bneither\b|\bnor\b|\bfailed to\b|并非|并不|尚未?|未(?:能|曾|见|检测|发现|观察|报道|明确|知|确定|发表|处理|显示|证明|发生|出现|达到|得到)"
    r"|不(?:会|能|再|足以|得|具有|影响|需要|依赖|明确|清楚|存在|是|应|可|属于|包括|发生|产生|导致|支持|改变|降低|增加|升高|减少|表明|显示|认为|知)"
    r"|无(?:法|需|须|关|效|明显|显著|差异|影响|证据|变化|异常|反应|作用|表达|相关)|没有|不超过|不促进|难以|直到[^。！？.!?]{0,40}才",
}
DEGREE = {
    "possibility": r"\bmay\b|\bmight\b|\bcould\b|可能(?!性)|或许|也许|预计",
    "suggestion": r"\bsuggest(?:s|ed)?\b|提示|提出|表明",
    "approximate": r"\bapproximately\b|\babout\b|约",
    "significant": r"\bsignificantly\b|显著",
    "slight": r"\bslightly\b|略微|稍(?:微|有|显|低|高|小|大|少|多)|略(?:低|高|小|大|少|多|有|显)|轻微",
    "strong": r"\bstrongly\b|强烈|强相关|强(?:阳性|表达|染色)",
}
LOGIC = {
    "reason": r"\bbecause\b|\bdue to\b|因为|由于",
    "result": r"\btherefore\b|\bthus\b|因此|所以|从而|进而|由此|导致",
    "association": r"\bassociated with\b|相关|有关|关联|结合",
    "contrast": r"\balthough\b|\bhowever\b|\bwhereas\b|尽管|然而|不过|而(?=[A-Za-zͰ-Ͽ])|而(?!且|后|今)(?=[㐀-鿿])",
    "condition": r"\bif\b|\bprovided that\b|如果|若",
    "comparison": r"\bcompared with\b|\bversus\b|相较(?:于)?|与(?:[^。！？.!?]|(?<=\d)\.(?=\d)){0,120}相比|比[^。！？.!?]{0,30}(?:更|较|高|低|多|少|大|小)|(?<!比)较(?=[^。！？.!?]{0,20}(?:增加|减少|升高|降低|高|低|多|少|大|小))",
}
