"""Problem 2: sentence units of texts in any language and script.

Candidates are the closing marks (and, in Thai, the blanks). Structure settles some of them: a mark within a number, a
label that opens the text, or a quotation or bracket within a sentence never ends one. The rest are classified by a
maximum-entropy model over the neighbouring tokens, their case, length, digits and script. The model is trained on
reliable boundaries: marks whose surroundings leave no doubt, labelled by ``certain``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable

import numpy as np

# Closing marks, and what may stand right after them.
FULL = "。！？｡．।॥؟۔።‽"
PLAIN = ".!?"
DOTS = "…‥⋯"
OPEN = {"(": ")", "（": "）", "[": "]", "【": "】", "〔": "〕", "{": "}", "“": "”", "«": "»", "「": "」", "『": "』", "„": "“", "《": "》", "〈": "〉", "‹": "›"}
QUOTES = "“«「『„‹\""
CLOSERS = "”’\"'»」』）)]】〉》›〕"
MARK = re.compile(f"[{re.escape(FULL + PLAIN + DOTS)}]+")
AFTER = re.compile(r"(?:[”’\"'»」』）)\]】〉》›〕]|(?<=„)“|[ \u00a0\u202f\u2009]?»|\[\d{1,4}(?:\s?[,;–-]\s?\d{1,4})*\]|［\d{1,4}(?:[,，–-]\d{1,4})*］|[⁰¹²³⁴-⁹]+|[*†‡](?=\s|$))")
REFERENCE = re.compile(r"(?:\[\d{1,4}(?:\s?[,;–-]\s?\d{1,4})*\]|[⁰¹²³⁴-⁹]+)")
WORD = re.compile(r"[^\W_]")
BRACKETS = re.compile("[" + re.escape("".join(OPEN) + "".join(OPEN.values()) + '"') + "]")
THAI_BLANK = re.compile(r"(?<=[฀-๿])\s+(?=[฀-๿])")
LABEL = re.compile(
    r"\s*[†‡*§¶]*\s*(?:(?:Fig|Figs|Figure|Tab|Table|Eq|Sec|Section|Ch|Chapter|Abb|Tabelle|Tableau|Figura|Tabla|Box|App|Appendix|No|Nr|Рис|Табл|图|表|第)\.?\s*)?"
    r"(?:\d{1,4}(?:\.\d{1,4})*|[IVXLC]{1,5}|[A-Z])(?:[.．)）](?=\s|$|[^\W\d]))",
)
# Abbreviations before names, abbreviations before labels or within sentences, and those that may end one.
TITLES = {"dr", "dra", "prof", "profa", "mr", "mrs", "ms", "m", "mme", "mlle", "st", "sr", "sra", "srta", "hr", "fr", "ing", "mag", "gen", "col", "rev", "hon", "capt", "lt", "sgt", "pres", "gov", "sen", "rep"}
WITHIN = {"fig", "figs", "tab", "eq", "eqs", "sec", "secs", "ch", "chap", "cf", "vs", "e.g", "i.e", "no", "nos", "nr", "n", "vol", "pp", "p", "ed", "eds", "abb", "abs", "z", "b", "z.b", "d.h", "u.a", "bzw", "vgl", "ca", "ref", "refs", "approx", "resp", "núm", "art", "pág", "рис", "табл", "т", "см", "им", "ph", "viz", "dept", "univ", "int", "max", "min", "avg", "lib", "app"}
ENDERS = {"etc", "a.m", "p.m", "al", "inc", "ltd", "co", "corp", "jr", "usw", "u.s", "b.c", "a.d", "ph.d", "d", "bros"}
ORDINAL_BEFORE = {"am", "vom", "zum", "der", "dem", "den", "im", "die", "das", "des", "ab", "bis", "beim"}
# Words that go on after a quotation, and reporting verbs that close a clause.
GOES_ON = ("随后", "然后", "接着", "的", "と", "って", "という", "并", "便", "就", "，", ",", "、", "；", ";", "：", ":", "라고", "고 ")
REPORTS = re.compile(r"(?:写道|说道|说|问道|问|指出|表示|认为|记录|答道|喊道|强调|宣布|writes?|wrote|said|says|asked|noted|added)[。.!！]?$")
TOKEN = re.compile(r"(?:[^\W_]+\.)*[^\W_]*$")
NEXT = re.compile(r"[^\W_]+")
#: Sentences whose boundaries are beyond doubt, so that the model can be trained where a corpus offers none.
SEED = (
    "We met Dr. Smith at 7 p.m. yesterday. The talk, i.e. the first, cost approx. 5 dollars. It ended at 9 p.m. Nobody left.\n"
    "See Fig. 2 and Tab. 3 for the values, cf. Sec. 4. Earlier work by Miller et al. [3] agrees. J. K. Lee wrote it. Apples, pears, etc. Others agree.\n"
    "Am 24. Tag fiel der Wert. Die Probe wog z. B. 3 g. M. Dupont a répondu. La Dra. López midió 3,5 mm. Le test est fini.\n"
    "调查结束了。结果很好！为什么下降？因为温度低。[3]由此可知。¹如图所示。\n結果は図に示す。なぜ値が下がったのか？膜は厚い。\n"
    "परत मोटी थी। मान क्यों घट गया? सेंसर ठीक है।\nلماذا انخفضت القيمة؟ تم القياس مرة. انتهى الاختبار.\n결과는 그림에 있다. 왜 값이 낮아졌는가? 센서는 보정되었다.\n"
    "Датчик был проверен. Результаты приведены на рис. 5 ниже. Почему значение упало? Образцы сушили.\n¿Por qué desciende el valor? La prueba terminó. ¡La válvula se abrió! Las muestras pesaron poco.\n"
    "Où se trouve la limite ? Le capteur a été étalonné. Les échantillons ont été pesés ! Rien ne change.\n"
)


def pairs_of(text: str) -> tuple[list[int], dict[int, int]]:
    """For each position the start of the innermost bracket or quotation that holds it (-1: none), and the places where
    each pair closes. Openings without an end and ends without an opening count for nothing."""
    stack: list[tuple[int, str]] = []
    waiting: Counter[str] = Counter()  # open marks by what closes them
    closed: dict[int, int] = {}

    def close(c: str, i: int) -> None:
        while stack[-1][1] != c:
            waiting[stack.pop()[1]] -= 1
        waiting[c] -= 1
        closed[stack.pop()[0]] = i

    for m in BRACKETS.finditer(text):
        c, i = m[0], m.start()
        if waiting[c] and not (c == "“" and stack[-1][1] != "“"):
            close(c, i)
        elif c == '"' or c in OPEN:
            stack.append((i, OPEN.get(c, c)))
            waiting[stack[-1][1]] += 1
    inside = [-1] * (len(text) + 1)
    for a in sorted(closed):
        inside[a + 1 : closed[a]] = [a] * (closed[a] - a - 1)
    return inside, closed


def _next(text: str, at: int) -> str:
    m = NEXT.search(text, at, min(len(text), at + 40))
    return m[0] if m else ""


def _case(word: str) -> str:
    if not word:
        return "none"
    c = word[0]
    if c.isdigit():
        return "digit"
    if "⺀" <= c <= "鿿" or "぀" <= c <= "ヿ" or "가" <= c <= "힣":
        return "cjk"
    if c.isupper():
        return "upper" if len(word) == 1 or not word.isupper() else "capitals"
    return "lower" if c.islower() else "caseless"


def _token(text: str, start: int) -> tuple[str, str]:
    """The token before a mark, and its kind."""
    token = TOKEN.search(text, max(0, start - 30), start)[0]
    low, at = token.lower(), start - len(token)
    before = text[at - 1 : at]
    if token and "°" in text[max(0, at - 2) : at] or (len(token) < 4 and token.isalpha() and before.isspace() and text[at - 2 : at - 1].isdecimal()):
        return token, "unit"
    if low in TITLES:
        return token, "title"
    if low in WITHIN:
        return token, "within"
    if low in ENDERS:
        return token, "ender"
    if len(token) == 1 and token.isupper():
        return token, "initial"
    if token.isdigit():
        if len(token) > 3 or (before and before in ":.,/–-"):
            return token, "number"
        m = re.search(r"([^\W_]+)\s*$", text[max(0, at - 20) : at])
        return token, "ordinal" if len(token) < 3 and m and m[1].lower() in ORDINAL_BEFORE else "digits"
    return token, "dotted" if "." in token else "word"


def _sort(text: str, start: int, end: int) -> str:
    mark = text[start]
    if mark in FULL or (mark == "." and end - start == 1 and start and _case(text[start - 1]) == "cjk"):
        return "full"
    if mark in DOTS or (end - start > 1 and set(text[start:end]) <= set("." + DOTS)):
        return "dots"
    return "stop" if mark == "." else "call"


def features(text: str, start: int, end: int, after: int, follow: int) -> list[str]:
    """Of the mark at start..end, its closing quotes and references up to ``after``, the next visible character at ``follow``."""
    token, kind = _token(text, start)
    coming = _next(text, follow)
    gap = "newline" if "\n" in text[after:follow] else "blank" if follow > after else "none"
    case = _case(coming)
    lead = text[follow] if follow < len(text) else ""
    size = "0" if not token else "1" if len(token) == 1 else "2-3" if len(token) < 4 else "4+"
    sort = _sort(text, start, end)
    closers = "closed" if after > end else "bare"
    out = [f"sort={sort}", f"kind={kind}", f"case={case}", f"gap={gap}", f"size={size}", f"{sort}|{case}|{gap}", f"{kind}|{case}", f"{kind}|{gap}", f"{sort}|{closers}|{case}", f"script={_case(token)}", f"lead={'word' if lead.isalnum() else lead}", "bias"]
    if kind in ("word", "dotted") and sort == "stop":
        out.append(f"token={token.lower()[:12]}")
    return out


def certain(text: str, start: int, end: int, after: int, follow: int) -> int:
    """1: surely a boundary, 0: surely none, -1: in doubt."""
    token, kind = _token(text, start)
    sort = _sort(text, start, end)
    case = _case(_next(text, follow))
    if sort == "dots":
        return 0 if "\n" not in text[after:follow] else -1
    if sort == "full":
        return 1
    if case == "lower" or (sort == "stop" and follow == after and case == "digit"):
        return 0
    if sort == "call":
        return 1 if case in ("upper", "capitals", "cjk") else -1
    if kind in ("title", "within", "initial", "ordinal"):
        return 0
    if "\n" in text[after:follow]:
        return 1
    if follow == after:
        return -1
    if case in ("upper", "capitals", "cjk", "caseless") and (kind in ("unit", "number") or (kind == "word" and len(token) >= 4 and token.isalpha())):
        return 1
    return 1 if case == "upper" and kind == "ender" and token.lower() != "al" else -1


class MaxEnt:
    """A binary maximum-entropy model; a feature that training never saw weighs nothing."""

    def __init__(self, weights: dict[str, float]) -> None:
        self.weights = weights

    def score(self, found: list[str]) -> float:
        get = self.weights.get
        return sum(get(f, 0.0) for f in found)

    @classmethod
    def fit(cls, examples: Iterable[tuple[list[str], int, int]], rounds: int = 150, penalty: float = 1e-4, least: int = 3) -> MaxEnt:
        """``examples``: features, label and how often the two stand together."""
        examples = list(examples)
        count: dict[str, int] = {}
        for found, _, n in examples:
            for f in found:
                count[f] = count.get(f, 0) + n
        index = {f: k for k, f in enumerate(sorted(f for f, n in count.items() if n >= least or not f.startswith("token=")))}
        rows = np.concatenate([np.full(len(x), i) for i, (x, _, _) in enumerate(examples)])
        columns = np.asarray([index.get(f, -1) for x, _, _ in examples for f in x])
        rows, columns = rows[columns >= 0], columns[columns >= 0]
        y = np.asarray([label for _, label, _ in examples], float)
        times = np.asarray([n for _, _, n in examples], float)
        w = np.zeros(len(index))
        square = np.full(len(index), 1e-8)
        for _ in range(rounds):  # steps scaled by each feature's own gradients
            p = 1 / (1 + np.exp(-np.bincount(rows, w[columns], len(y))))
            slope = np.bincount(columns, ((p - y) * times)[rows], len(w)) / times.sum() + penalty * w
            square += slope**2
            w -= 0.5 * slope / np.sqrt(square)
        return cls({f: float(w[k]) for f, k in index.items()})


def marks(text: str) -> Iterable[tuple[int, int, int, int]]:
    """start, end, after, follow of every run of closing marks."""
    at = 0
    for m in MARK.finditer(text):
        if m.start() < at:
            continue
        after = m.end()
        while (x := AFTER.match(text, after)) is not None and x.end() > after:
            after = x.end()
        follow = after
        while follow < len(text) and text[follow].isspace():
            follow += 1
        yield m.start(), m.end(), after, follow
        at = m.end()


def examples(texts: Iterable[str]) -> list[tuple[list[str], int]]:
    found = []
    for text in texts:
        inside, _ = pairs_of(text)
        label = LABEL.match(text)
        first = label.end() if label else 0
        for start, end, after, follow in marks(text):
            if start < first or follow >= len(text) or inside[start] >= 0:
                continue
            if (sure := certain(text, start, end, after, follow)) >= 0:
                found.append((features(text, start, end, after, follow), sure))
    return found


#: Between the features of an example as one string; white space, which no feature holds.
BETWEEN = "\x1f"


def counted(texts: Iterable[str]) -> Counter[tuple[str, int]]:
    """How often each example stands in ``texts``, its features as one string."""
    return Counter((BETWEEN.join(found), sure) for found, sure in examples(texts))


def fitted(counts: Counter[tuple[str, int]]) -> MaxEnt:
    """The model of counted examples and of the fixed sentences."""
    whole = counted(SEED.split("\n") * 5)
    whole.update(counts)
    names: dict[str, str] = {}  # each feature's string once
    return MaxEnt.fit([([names.setdefault(f, f) for f in found.split(BETWEEN)], sure, n) for (found, sure), n in sorted(whole.items())])


def train(texts: Iterable[str]) -> MaxEnt:
    return fitted(counted(texts))


#: Small words that go on with a sentence after an abbreviation.
LINKS = {"and", "or", "but", "to", "with", "in", "of", "for", "by", "on", "is", "was", "were", "are", "from", "than", "students"}


def _one_case(text: str) -> bool:
    """Whether most letters of a text have a case and all of them the same one, so that case tells nothing."""
    if text != text.lower() and text != text.upper():
        return False
    cased = sum(c.upper() != c.lower() for c in text)
    return cased > 12 and cased * 2 > sum(map(str.isalpha, text))


def _ends_without_case(text: str, start: int, end: int, after: int, follow: int, quoted: bool) -> bool:
    """A mark in a text of one case: what the token before it and the word behind it allow."""
    if _sort(text, start, end) == "full":
        return True
    token, kind = _token(text, start)
    coming = _next(text, follow).lower()
    if quoted:
        return text[start] == "."  # an exclamation or a question is followed by who said it
    if text[start] != ".":
        return True
    if follow == after:
        return kind in ("word", "unit") and len(token) > 2 and not coming[:1].isdigit() and coming.isalpha()
    if kind in ("title", "within", "initial", "ordinal") or token.lower() in ("al", "ph.d", "d") or (len(token) == 1 and kind != "unit"):
        return False
    return not (kind in ("ender", "dotted") and coming in LINKS)


def _ends_after_quote(text: str, model: MaxEnt, opened: int, begun: int, start: int, end: int, after: int, follow: int) -> bool:
    """A mark right before the end of a quotation; ``begun``: where the sentence so far starts."""
    rest = text[follow:]
    if rest.startswith(GOES_ON):
        return False
    case = _case(_next(text, follow))
    if text[follow : follow + 1].isalnum() and case == "lower":
        return False
    leading = not text[begun:opened].strip()
    if case in ("cjk", "upper", "digit", "capitals") and leading:
        coming = MARK.search(text, follow)
        clause = text[follow : coming.start() if coming else len(text)]
        if not re.search("[：:“「『«\"]", clause) and REPORTS.search(clause):
            return False
    return _sort(text, start, end) == "full" or model.score(features(text, start, end, after, follow)) > 0


def sentences(text: str | None, model: MaxEnt) -> list[tuple[int, int]]:
    """Start and end of each sentence, without white space around; null and blank texts give none."""
    if not text or not text.strip():
        return []
    inside, closed = pairs_of(text)
    label = LABEL.match(text)
    opening = label.end() if label else 0
    plain = _one_case(text)
    cuts: list[int] = []
    begun = 0
    blanks = [m.end() for m in THAI_BLANK.finditer(text)] if "฀" <= max(text) else []
    for start, end, after, follow in marks(text):
        if start < begun:
            continue
        if start < opening and end <= opening:
            continue
        if follow >= len(text):
            break
        held = inside[start]
        if _sort(text, start, end) == "dots" and "\n" not in text[after:follow] and _case(_next(text, follow)) in ("lower", "cjk", "digit"):
            continue  # a pause
        if held >= 0:
            outer = held
            while inside[outer] >= 0:
                outer = inside[outer]
            close = closed[outer]
            if not end <= close < after:
                continue  # within a quotation or bracket
            if text[outer] not in QUOTES:
                ends = not text[begun:outer].strip()
            elif plain:
                ends = _ends_without_case(text, start, end, after, follow, True)
            else:
                ends = _ends_after_quote(text, model, outer, begun, start, end, after, follow)
        elif plain:
            ends = _ends_without_case(text, start, end, after, follow, False)
        elif follow == after and _sort(text, start, end) == "stop":
            ends = _ends_without_blank(text, model, start, end, after, follow)
        else:
            ends = model.score(features(text, start, end, after, follow)) > 0
        if ends:
            cuts.append(after)
            begun = after
    cuts = sorted({*cuts, *blanks, len(text)})
    out, at = [], 0
    for stop in cuts:
        piece = text[at:stop]
        kept = piece.strip()
        if kept and WORD.search(kept):
            first = at + len(piece) - len(piece.lstrip())
            out.append((first, first + len(kept)))
        at = stop
    return out


def _ends_without_blank(text: str, model: MaxEnt, start: int, end: int, after: int, follow: int) -> bool:
    """A full stop with no blank behind: only before a word that opens a sentence, after a word that is no abbreviation."""
    if after > end and follow < len(text) and REFERENCE.search(text, end, after):
        return model.score(features(text, start, end, after, follow)) > 0
    coming = text[follow : follow + 2]
    token, kind = _token(text, start)
    opens = coming[:1].isupper() and (coming[1:].islower() or coming[1:] in (" ", "’", "'"))
    opens = opens or coming[:1] in QUOTES or _case(coming[:1]) == "cjk"
    if not opens or kind in ("title", "within", "dotted", "initial"):
        return False
    return kind == "unit" or not token[:1].isupper() or len(token) > 3
