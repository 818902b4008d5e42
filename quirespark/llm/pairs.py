"""Problem 3: prompt and answer pairs with a defective answer.

The prompt's suffix automaton is traversed by the answer, which gives how much of the answer is copied from the prompt;
an Aho-Corasick automaton finds phrases of refusal; stacks of delimiters and what comes before the last mark tell an
answer that breaks off; letters by script and votes of stopwords tell its language. The first defect of ``DEFECTS`` that
holds is the unit's defect.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from functools import lru_cache

import ahocorasick

from quirespark.llm.lookalike import normal_form

DEFECTS = ("empty", "copy", "refusal", "wrong_language", "truncated")
# Phrases by which an answer declines, lower case, without spaces or punctuation.
REFUSALS = {
    "zh": "无法翻译 不能翻译 难翻译 拒绝翻译 拒绝对 不便提供 不在可协助 无法协助 不能协助 超出了我的能力 超出我的能力 没有办法完成 无法完成 不能处理 无法处理 我无法 我不能 无法提供 不能提供 作为翻译助手 作为助手 作为人工智能 作为ai 作为语言模型 无法满足 不予翻译 恕不 拒绝处理 拒绝提供 暂不支持 無法翻譯 不能翻譯",
    "en": "icanttranslate icannottranslate unabletotranslate notabletotranslate notabletohelp notabletoassist cannotbeprocessed cantbeprocessed mustdecline ihavetodecline declineto imsorrybut iamsorrybut asanassistant asanai asalanguagemodel icanthelp icannothelp cantassist cannotassist iwontbeable iamunable imunable refuseto icantprocess icannotprocess icantprovide icannotprovide cannotcomply cantcomply outsidemyabilities beyondmyabilities notpossibleformeto",
    "fr": "nepeuxpastraduire nepuispastraduire nesuispasenmesure jesuisdésolémais jeregrettemais nepeuxpasvousaider refusedetraduire entantquassistant impossibledetraduire",
    "de": "kannichnichtübersetzen nichtübersetzenkann kanndiesentextnicht leiderkannich tutmirleid bedauereaber alsassistent lehneesab nichthelfen",
    "es": "nopuedotraducir losientopero nopuedoayudar comoasistente nopuedoprocesar mevopuedo nomeesposible rechazotraducir",
    "ja": "翻訳できません 翻訳することができません お手伝いできません 申し訳ありませんが 対応できません お断り",
    "ko": "번역할수없습니다 도와드릴수없습니다 죄송하지만 처리할수없습니다",
    "ru": "немогуперевести немогупомочь извинитено ксожалениюя какассистент",
    "it": "nonpossotradurre nonpossoaiutar nonsonoingrado midispiacema sonospiacentema comeassistente rifiutoditradurre impossibiletradurre",
    "pt": "nãopossotraduzir nãoconsigotraduzir nãopossoajudar nãoconsigoajudar lamentomas desculpemas sintomuitomas comoassistente recusotraduzir nãomeépossível",
    "ar": "لاأستطيعترجمة لايمكننيترجمة لاأستطيعمساعدتك لايمكننيمساعدتك لاأستطيعالمساعدة لايمكننيالمساعدة أعتذرعنترجمة بصفتيمساعدا تعذرتالترجمة",
    "hi": "अनुवाद नहीं कर सकत|अनुवाद करने में असमर्थ|मदद नहीं कर सकत|सहायता नहीं कर सकत|अनुवाद करना संभव नहीं|क्षमा करें लेकिन",
    "th": "ไม่สามารถแปล|แปลไม่ได้|ไม่สามารถช่วย|ขออภัยแต่|ปฏิเสธที่จะแปล|ในฐานะผู้ช่วย",
}
# What a sentence about the request itself holds, where the answer speaks of itself, of who asked, or of translating.
ABOUT = re.compile(
    r"我(?!们|們|国)|您|你|翻译|翻譯|译文|译者|请求|抱歉|对不起|遗憾|助手|如需|内容受限|换一段|其他文本"
    r"|\b(?:I|I['’]m|I['’]d|me|my|you|your|please|sorry|apolog\w+|unfortunately|translat\w+|request\w*|assist\w*|je|j['’]\w+|vous|votre|désolée?|tradu\w+|ich|sie|ihnen|ihre?|bitte|leider|übersetz\w+|lo siento|usted|su solicitud|por favor|mi dispiace|posso|você|desculp\w+|lamento)\b"
    r"|перев[оеё]|извин|запрос|翻訳|申し訳|ください|번역|죄송|도와|ترجم|عذر|طلب|अनुवाद|क्षमा|अनुरोध|แปล|ขออภัย|คำขอ",
    re.I,
)
# A source that itself says that something cannot be done, or regrets; its rendering says so, too.
DECLINING = re.compile(r"\b(?:cannot|can['’]?t|could not|couldn['’]t|unable|not (?:be )?able|not possible|impossible|refus\w+|declin\w+|sorry|regret\w*|assistants?)\b", re.I)
SENTENCE_ENDS = re.compile(r"[。！？!?؟।\n]+|\.(?=\s|$)|(?<=[฀-๿])\s+(?=[฀-๿])")
# Stopwords by language.
STOPWORDS = {
    "en": "the of and to in is was that for it with as on by at from are were this which be not or an we our each a how under its",
    "fr": "le la les de des du et un une est dans que qui pour par sur au aux avec ce cet cette a été ont se où",
    "de": "der die das und ist in den von zu mit dem des ein eine für auf nach bei im sich wird wurde wurden vor am als nicht",
    "es": "el la los las de del y en que un una se es por con para al su fue como no si según señor",
    "it": "il lo gli di e che un una è per con del della nel sono si non",
    "pt": "o os as de e que um uma é para com do da no na em por se não",
}
SCRIPTS = {"kana": (0x3040, 0x30FF), "hangul": (0xAC00, 0xD7A3), "thai": (0xE00, 0xE7F), "arabic": (0x600, 0x6FF), "devanagari": (0x900, 0x97F), "cyrillic": (0x400, 0x4FF), "hebrew": (0x590, 0x5FF), "greek": (0x370, 0x3FF)}
OPENERS = {"（": "）", "(": ")", "“": "”", "「": "」", "『": "』", "《": "》", "【": "】", "[": "]", "〔": "〕", "«": "»"}
ENDERS = {v: k for k, v in OPENERS.items()}
TAIL = re.compile(r"[\s​﻿]*(?:(?:\[\d+(?:[,，–-]\s?\d+)*\]|[⁰¹²³⁴-⁹]+)[\s​﻿]*)*$")
CLOSING = "”’\"'」』）)】»》"
LINES = {"title", "heading", "keywords"}
WORD = re.compile(r"[^\W_]")
IDEOGRAPHS = re.compile("[㐀-鿿]+")
KEPT = re.compile(r"\d+(?:[.,]\d+)*|[A-Z][A-Za-z]{2,}")
LEAD = 80
LEAD_END = re.compile(r"[\W_]+")
LEAD_MARK = re.compile(r"[:：\n—“\"「『*]+")


def bare(text: str) -> str:
    """Letters and digits in lower case; look-alike characters count as the plain ones."""
    return "".join(c for c in normal_form(text).casefold() if c.isalnum())


def flat(text: str) -> str:
    return "".join(c for c in text.casefold() if c.isalnum())


class SuffixAutomaton:
    """All substrings of a text as paths from state 0."""

    def __init__(self, text: str) -> None:
        go: list[dict[str, int]] = [{}]
        link, length = [-1], [0]
        last = 0
        for c in text:
            new = len(go)
            go.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in go[p]:
                go[p][c] = new
                p = link[p]
            if p >= 0:
                q = go[p][c]
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    twin = len(go)
                    go.append(go[q].copy())
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and go[p].get(c) == q:
                        go[p][c] = twin
                        p = link[p]
                    link[q] = link[new] = twin
            last = new
        self.go, self.link, self.length = go, link, length

    def stretches(self, text: str, least: int) -> list[tuple[int, int]]:
        """Start and end of the parts of ``text`` within its matches of at least ``least`` characters, none overlapping."""
        go, link, length = self.go, self.link, self.length
        found = []
        state = size = reach = 0
        for i, c in enumerate(text):
            while state and c not in go[state]:
                state = link[state]
                size = length[state]
            if c in go[state]:
                state, size = go[state][c], size + 1
            else:
                size = 0
            if size >= least:
                found.append((max(reach, i + 1 - size), i + 1))
                reach = i + 1
        return found

    def covered(self, text: str, least: int) -> int:
        """Characters of ``text`` within its matches of at least ``least`` characters."""
        return sum(b - a for a, b in self.stretches(text, least))


@lru_cache(maxsize=1)
def refusal_automaton() -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for lang, phrases in REFUSALS.items():
        for phrase in phrases.split("|") if "|" in phrases else phrases.split():
            automaton.add_word(flat(phrase), lang)
    automaton.make_automaton()
    return automaton


@lru_cache(maxsize=1)
def _stopwords() -> dict[str, tuple[str, ...]]:
    votes: dict[str, tuple[str, ...]] = {}
    for lang, words in STOPWORDS.items():
        for w in words.split():
            votes[w] = (*votes.get(w, ()), lang)
    return votes


def language(text: str) -> str:
    """zh, another script's name, or the Latin language with most stopword votes ("latin" without any)."""
    han = letters = 0
    scripts: Counter[str] = Counter()
    for c in text:
        cp = ord(c)
        if 0x3400 <= cp <= 0x9FFF or 0x20000 <= cp <= 0x3FFFF:
            han += 1
        elif cp >= 0x370 and (name := next((n for n, (a, z) in SCRIPTS.items() if a <= cp <= z), "")):
            scripts[name] += 1
        elif c.isalpha():
            letters += 1
    if scripts:
        name, n = scripts.most_common(1)[0]
        if (name == "kana" and n >= 2 and n * 4 >= han) or (name != "greek" and n > han + letters // 2):
            return name
    small = sum(map(len, re.findall(r"\b[^\W\d_A-ZÀ-Þ一-鿿][^\W\d_一-鿿]*", text))) if han else 0
    if han and (han * 4 >= letters + han or han * 2 >= small):  # names in Latin letters are no running text
        return "zh"
    votes: Counter[str] = Counter()
    for w in re.findall(r"[^\W\d_]+", text.lower()):
        votes.update(_stopwords().get(w, ()))
    return votes.most_common(1)[0][0] if votes else ("latin" if letters else "none")


def open_delimiter(text: str) -> bool:
    """Whether a bracket or quotation is still open where the text ends."""
    stack: list[str] = []
    for c in text:
        if c in OPENERS:
            stack.append(c)
        elif c in ENDERS and ENDERS[c] in stack:
            while stack.pop() != ENDERS[c]:
                pass
    return bool(stack) or (text.count('"') % 2 == 1 and '"' in text)


#: Share of a pair's occurrences that stand right before a closing mark, from which on it may end a text.
LEAST_BEFORE = 0.02


class Finals:
    """How often two characters (digits alike) come right before a closing mark; learned from sound sentences."""

    def __init__(self, before: dict[str, int], anywhere: dict[str, int]) -> None:
        self.before, self.anywhere = before, anywhere

    @staticmethod
    def key(text: str) -> str:
        return re.sub(r"\d", "0", text[-2:])

    @classmethod
    def fit(cls, texts: Iterable[str]) -> Finals:
        before: Counter[str] = Counter()
        anywhere: Counter[str] = Counter()
        for text in texts:
            flat = re.sub(r"\d", "0", text)
            anywhere.update(flat[i : i + 2] for i in range(len(flat) - 1))
            before.update(flat[m.start() - 2 : m.start()] for m in re.finditer("[。！？]", flat) if m.start() >= 2)
        return cls(dict(before), dict(anywhere))

    def ends(self, text: str) -> bool:
        k = self.key(text)
        return self.before.get(k, 0) >= LEAST_BEFORE * max(1, self.anywhere.get(k, 0)) and k in self.before


def final_mark(text: str) -> str:
    """The closing mark that ends a text, before closing quotes and references; empty if there is none."""
    core = TAIL.sub("", text)
    inner = core.rstrip(CLOSING).rstrip()
    mark = inner[-1:]
    if mark in "。！？!?．｡।؟" and mark:
        return mark
    return "." if mark == "." and not inner.endswith("..") else ""


def truncated(source: str, target: str, role: str, finals: Finals) -> bool:
    core = TAIL.sub("", target)
    if not core:
        return False
    if open_delimiter(core):
        return True
    if core[-1] in "、，,：:；;（(“「《—-/":
        return True
    if role in LINES:
        return False
    mark = final_mark(target)
    if mark:
        inner = core.rstrip(CLOSING).rstrip()
        if mark == "." and inner[-2:-1].isdigit() and "。" in target and not re.search("[㐀-鿿][.．]", target) and re.search(r"\d*$", inner[:-1])[0] != re.search(r"(\d*)\D*$", source)[1]:
            return True  # a point within a number
        if core[-1] in "”」』\"" and mark in "！？!?":  # a quotation at the end must have been announced
            opened = max(core.rfind(c, 0, len(core) - 1) for c in "“「『\"")
            lead = core[:opened].rstrip()
            return opened >= 0 and lead[-1:] not in tuple("：:，,")
        return False
    if final_mark(source):
        return True
    if core.endswith(("…", "...")):
        return not source.rstrip().endswith(("…", "..."))
    return not finals.ends(core)


def copied(source: str, target: str, lang: str) -> str | None:
    """'copy' where an answer repeats the prompt, 'truncated' where it is a few words of the prompt and nothing else.

    At least 80 % of the answer must be the prompt's, with or without a lead-in of at most ``LEAD`` characters. Behind a
    lead-in, 80 % of the prompt must come as well, and in an answer that counts as Chinese a mark must part the two, so
    that an explained name is no copy.
    """
    chinese = lang == "zh"
    if chinese and len(IDEOGRAPHS.sub("", target)) * 2 < len(source):
        return None
    own, given = bare(target), bare(source)
    alphabet = set(given)
    shared = sum(c in alphabet for c in own)
    if not own or (shared * 10 < 8 * len(own) and shared * 10 < 8 * len(given)):  # so much cannot be copied
        return None
    if chinese and (shared * 10 < 8 * len(given) or language(source) == "zh"):
        return None
    least = max(3, min(12, len(own) // 2, len(given) // 2))
    found = SuffixAutomaton(given).stretches(own, least)
    if not chinese and sum(b - a for a, b in found) * 10 >= 8 * len(own):
        return "copy" if len(own) * 5 >= 2 * len(given) else "truncated"  # a few words of it are no repetition
    for m in (LEAD_MARK if chinese else LEAD_END).finditer(target[:LEAD]):
        first = len(bare(target[: m.end()]))
        size = sum(b - max(a, first) for a, b in found if b > first)
        if size and size * 10 >= 8 * max(len(given), len(own) - first):
            return "copy"
    return None


def refuses(source: str, target: str) -> bool:
    """Whether an answer of any length declines instead of translating.

    A sentence with a phrase of refusal counts wherever it stands; where the source says that something cannot be done,
    it must also be about the request. The sentences that decline or are about the request must make up most of the
    answer, and no other sentence may hold a number or name of the source, as a rendered one does.
    """
    if next(refusal_automaton().iter(flat(target)), None) is None:
        return False
    strict = DECLINING.search(source) is not None
    given = set(KEPT.findall(source))
    declines, about, other = False, 0, 0
    for part in SENTENCE_ENDS.split(target):
        own = flat(part)
        near = ABOUT.search(part) is not None
        if next(refusal_automaton().iter(own), None) is not None and (near or not strict):
            declines = True
            about += len(own)
        elif near:
            about += len(own)
        elif own:
            if not given.isdisjoint(KEPT.findall(part)):
                return False
            other += len(own)
    return declines and about > other


def defect(source: str | None, target: str | None, role: str, finals: Finals) -> str | None:
    """The defect of an answer, or None."""
    if target is None or not WORD.search(target):
        return "empty"
    lang = language(target)
    prompt = source or ""
    if (repeats := copied(prompt, target, lang)) is not None:
        return repeats
    if refuses(prompt, target):
        return "refusal"
    if lang not in ("zh", "none"):
        return "wrong_language"
    return "truncated" if lang == "zh" and truncated(prompt, target, role, finals) else None
