"""The operators for training text: literal cases, brute force, and rows with nulls, ties, repetitions and nothing."""

import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quirespark.llm import align, align_queries, fmindex, leaks, leaks_queries, lookalike, lookalike_queries, mojibake, mojibake_queries, pairs, pairs_queries, sentences, sentences_queries, spans_queries, tokenize, tokenize_queries

LONG = "word " * 40_000


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


# 1


@pytest.mark.parametrize(
    ("given", "expected"),
    [("Теѕt-оffісе", "Test-office"), ("ﬁﬃ ｒ​\xad", "fiffi r"), ("é é", "é é"), ("⽔⼀", "水一"), ("a\r\nb\rc", "a\nb\nc"), ("a\u00a0\u2007\u202fb\u2011c", "a   b-c"), ("각", "각"), ("ậ ậ", "ậ ậ"), ("½² … ™", "½² … ™"), ("", "")],
)
def test_normal_form(given, expected):
    assert lookalike.normal_form(given) == expected


def test_normal_forms_equal_a_loop():
    t = lookalike.tables()
    random.seed(1)
    letters = "abcéöñеорсｆﬁﬀ​̧́̂̈ \xa0\r\n가각ᆨ水⽔😀"
    texts = ["".join(random.choices(letters, k=random.randint(0, 30))) for _ in range(500)] + [None, ""]

    def loop(s):
        if s is None:
            return None
        s = s.replace("\r\n", "\n")
        return unicodedata.normalize("NFC", "".join(chr(c) for ch in s for c in t.flat[t.start[ord(ch)] : t.start[ord(ch)] + t.size[ord(ch)]]))

    assert lookalike.normal_forms(pa.array(texts, pa.string())).to_pylist() == [loop(s) for s in texts]


def test_lookalike_pairs(spark):
    data = [("line", "d", "d/1", "test"), ("line", "d", "d/2", "tеst"), ("line", "d", "d/3", "test"), ("line", "e", "e/1", "tеst"), ("line", "d", "d/4", "Test"), ("line", "d", "d/2", "tеst"), ("line", "d", "d/5", None), ("document", "", "1", "​"), ("document", "", "2", "")]
    frame = spark.createDataFrame(data, "kind string, place string, key string, text string")
    assert rows(lookalike_queries.lookalike_pairs(frame)) == [("line", "d/1", "d/2"), ("line", "d/2", "d/3")]
    assert rows(lookalike_queries.lookalike_pairs(frame.limit(0))) == []
    assert {(r.key, r.links) for r in lookalike_queries.lookalike_classes(frame).collect()} == {("d/1", 1), ("d/2", 2), ("d/3", 1)}
    assert rows(lookalike_queries.lookalike_classes(frame.limit(0))) == []
    wide = lookalike_queries.with_normal_form(frame.withColumn("normal_text", F.lit("clash")).withColumn("key", F.lit(7)))
    assert wide.columns.count("normal_text") == 1 and wide.where("text is null and normal_text is not null").count() == 0


def test_overprinted_glyphs(spark):
    kind = "doc_id string, page_number int, id string, text string, x0 long, y0 long, x1 long, y1 long"
    data = [("d", 1, "a", "e", 0, 0, 1, 1), ("d", 1, "b", "е", 0, 0, 1, 1), ("d", 1, "b", "е", 0, 0, 1, 1), ("d", 2, "c", "е", 0, 0, 1, 1), ("d", 3, "f", "e", 0, 0, 1, 1), ("d", 3, "g", "/", 0, 0, 1, 1), ("d", 4, "h", None, None, None, None, None)]
    assert {r.id for r in lookalike_queries.overprinted(spark.createDataFrame(data, kind)).collect()} == {"a", "b"}


# 2


@pytest.fixture(scope="module")
def model():
    return sentences.train(["The value rose. It then fell again.\nAll was well. Nothing more happened there."] * 5)


@pytest.mark.parametrize(
    ("given", "expected"),
    [
        ("It rose by 5.5 mg. Then it fell.", ["It rose by 5.5 mg.", "Then it fell."]),
        ("According to Dr. Kerult, it failed. J. K. Lee agreed.[4,35] See Fig. 2 here.", ["According to Dr. Kerult, it failed.", "J. K. Lee agreed.[4,35]", "See Fig. 2 here."]),
        ("It was sampled at 6 a.m. and at noon. The last was taken at 7 p.m. We left.", ["It was sampled at 6 a.m. and at noon.", "The last was taken at 7 p.m.", "We left."]),
        ("35.7. The pollinator", ["35.7. The pollinator"]),
        ("“It failed twice!” the operator wrote. Done.", ["“It failed twice!” the operator wrote.", "Done."]),
        ("Skip it (explained below. See the appendix). Go on.", ["Skip it (explained below. See the appendix).", "Go on."]),
        ("It was not stable ... it came back. Why?! Because.", ["It was not stable ... it came back.", "Why?!", "Because."]),
        ("委员会问道：“谁检查过？”随后宣布休会。好的。", ["委员会问道：“谁检查过？”随后宣布休会。", "好的。"]),
        ("“失败了两次！”第27号站的操作员在日志中写道。X说过：“好的。”由于老化，我们更换。", ["“失败了两次！”第27号站的操作员在日志中写道。", "X说过：“好的。”", "由于老化，我们更换。"]),
        ("参见下文。（以上为补充。）可见便宜；精度一样。¹²", ["参见下文。", "（以上为补充。）", "可见便宜；精度一样。¹²"]),
        ("ฟิล์มแตกหลัง เซนเซอร์ถูก", ["ฟิล์มแตกหลัง", "เซนเซอร์ถูก"]),
        ("परत थी। मान क्यों? ठीक", ["परत थी।", "मान क्यों?", "ठीक"]),
        ("M. X précise : « la couche n’a jamais cédé. » Le test est fini.", ["M. X précise : « la couche n’a jamais cédé. »", "Le test est fini."]),
        ("「これは失敗だ。」と彼は述べた。次。", ["「これは失敗だ。」と彼は述べた。", "次。"]),
        ("——", []),
        ("  \n ", []),
        (None, []),
        ("cut off in", ["cut off in"]),
    ],
)
def test_sentences(model, given, expected):
    assert [given[a:b] for a, b in sentences.sentences(given, model)] == expected


def test_sentence_rows(spark, model):
    frame = spark.createDataFrame([("d", "u", "One. Two went.", None, 1), ("d", "v", "", " ", 2), ("d", "w", LONG, None, 3)], "doc_id string, unit_id string, source_text string, target_text string, side int")
    assert rows(sentences_queries.sentence_units(frame, model)) == [("d", "u", "source", 0, 4), ("d", "u", "source", 5, 14), ("d", "w", "source", 0, len(LONG) - 1)]
    assert rows(sentences_queries.sentence_units(frame.limit(0), sentences_queries.sentence_model(frame.limit(0)))) == []


# 3


@pytest.mark.parametrize(
    ("source", "target", "expected"),
    [
        ("A film grew.", None, "empty"),
        ("A film grew.", "——", "empty"),
        ("A film grew over the whole probe.", "译文：a FILM grew over the whole probe", "copy"),
        ("A film grew.", "作为翻译助手，我无法翻译这段内容。", "refusal"),
        ("A film grew.", "I'm sorry, but I can't translate this passage.", "refusal"),
        ("A film grew.", "Le film est une couche de la sonde.", "wrong_language"),
        ("A film grew.", "結果は図30に示す。", "wrong_language"),
        ("A film grew.", "薄膜在探针上生", "truncated"),
        ("A film grew (see below. See there).", "薄膜生长（见下文。", "truncated"),
        ("A film grew.", "薄膜生长。", None),
        ("A film grew", "薄膜生长", None),
        (None, "薄膜生长。", None),
    ],
)
def test_defects(source, target, expected):
    finals = pairs.Finals.fit(["薄膜生长。", "它生长。"] * 3)
    assert pairs.defect(source, target, "body", finals) == expected


@pytest.mark.parametrize(
    ("source", "target", "expected"),
    [
        ("Limits of the substrate", "Translation: Limits of the substrate", "copy"),
        ("A film", "Translation: a film", "copy"),
        ("The film grew over the probe.", "Sure, here is the translation of the text: The film grew over the probe.", "copy"),
        ("The film grew over the probe.", "译文：THE FILM GREW OVER THE PROBE.", "copy"),
        ("The film grew.", "以下是这段文字的译文：THE FILM GREW.", "copy"),
        ("Using MODIS", "使用MODIS", None),
        ("MODIS", "中分辨率成像光谱仪 MODIS", None),
        ("The film grew over the probe.", "Le film est une couche de la sonde.", "wrong_language"),
    ],
)
def test_copies_behind_a_lead_in(source, target, expected):
    assert pairs.defect(source, target, "heading", pairs.Finals.fit([])) == expected


@pytest.mark.parametrize(
    ("target", "expected"),
    [
        ("I'm sorry, but I can't translate this passage. " + "Please send me another text and I will gladly look at your request. " * 8, "refusal"),
        ("Thank you very much for your request, and for telling me so plainly what you would like me to render. I can't translate this passage.", "refusal"),
        ("非常感谢您的来信，也感谢您把想要翻译的段落和它的背景都写得这样清楚，使我很快明白您要我做的是什么事情，也明白您为什么要我做这件事情。我无法翻译这段内容。", "refusal"),
        ("Mi dispiace, ma non posso tradurre questo testo.", "refusal"),
        ("Desculpe, mas não posso traduzir este texto.", "refusal"),
        ("عذراً، لا أستطيع ترجمة هذا النص.", "refusal"),
        ("क्षमा करें, मैं इस पाठ का अनुवाद नहीं कर सकता।", "refusal"),
        ("ขออภัย ฉันไม่สามารถแปลข้อความนี้ได้", "refusal"),
        ("薄膜在35号探针上生长。样品不能处理。", None),
        ("Le film est une couche de la sonde. La valeur est dans le tableau et ne change pas.", "wrong_language"),
    ],
)
def test_refusals_of_any_length(target, expected):
    source = "The film grew on probe 35. The sample could not be processed."
    assert pairs.defect(source, target, "body", pairs.Finals.fit(["薄膜生长。"] * 3)) == expected


def test_suffix_automaton_equals_brute_force():
    random.seed(2)
    for _ in range(200):
        a, b = ("".join(random.choices("ab", k=random.randint(0, 12))) for _ in range(2))
        covered = {i for i in range(len(b)) for x in range(len(b)) for y in range(x + 3, len(b) + 1) if x <= i < y and b[x:y] in a}
        assert pairs.SuffixAutomaton(a).covered(b, 3) == len(covered)


def test_defect_rows(spark):
    frame = spark.createDataFrame([("d", "u", None, None, None), ("d", "v", "body", LONG, LONG)], "doc_id string, unit_id string, unit_role string, source_text string, target_text string")
    assert rows(pairs_queries.defective_pairs(frame, pairs_queries.finals_model(frame))) == [("d", "u", "empty"), ("d", "v", "copy")]


# 4


@pytest.fixture(scope="module")
def mender():
    return mojibake.Mender({})


@pytest.mark.parametrize("name", ["cp1252", "latin_1", "cp437", "mac_roman", "cp1251"])
def test_wrong_decoding_is_undone(mender, name):
    table = {b: c for c, b in mojibake.byte_of(name).items()}
    for sound in ("“The film” reached 5 °C", "L’équipe a mesuré à 5 °C près", "薄膜生长了两次，然后停止。"):
        wrong = "".join(chr(b) if b < 0x80 else table[b] for b in sound.encode())
        assert mender.damage(wrong)[:2] == (True, sound)


def test_doubly_wrong_and_lost(mender):
    twice = "°C".encode().decode("cp1252").encode().decode("cp1252")
    assert mender.damage(f"at 5 {twice} now")[:2] == (True, "at 5 °C now")
    assert mender.damage("这部分恕难翻译，谢谢大家。".encode().decode("gb18030", "replace"))[0]
    assert mender.damage("薄膜生长了两次然后停止".encode("gb18030").decode("latin_1"))[:2] == (True, "薄膜生长了两次然后停止")
    assert mender.damage("lost � here") == (True, None, "")


@pytest.mark.parametrize("name", ["cp1252", "latin_1", "cp437", "mac_roman", "cp1251", "gb18030"])
def test_lost_characters_decoded_once_more(mender, name):
    table = {b: c for c, b in mojibake.byte_of(name).items()} if name != "gb18030" else {}
    again = "".join(table[b] for b in "�".encode()) if table else "��".encode().decode(name)
    assert mender.damage(f"the value {again} rose")[0] and mender.damage(again)[0]


def test_a_run_with_a_lost_character_is_undone(mender):
    assert mender.damage("caf" + "é�".encode().decode("cp1252"))[:2] == (True, "café�")


@pytest.mark.parametrize("sound", ["SÃO VELMO", "Âlbertiz", "“naïve” …", "Датчик был проверен", "毛驴在图5中", "Теѕt оf ѕреесh", "Quémârt–Çelikýn", "", None, "plain"])
def test_sound_text_stays(mender, sound):
    assert mender.damage(sound) == (False, None, "")


def test_mended_rows(spark):
    frame = spark.createDataFrame([("document", "1", "5 Â°C"), ("document", "1", "5 Â°C"), ("char", "a", None), ("line", "x", LONG)], "kind string, rec_key string, text string")
    assert rows(mojibake_queries.mended(frame, {}).distinct()) == [("document", "1", "5 °C", "cp1252>utf_8")]
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert mojibake_queries.dictionaries(docs) == {}


# 5


def test_alignment(spark):
    source = ["The film rose by 5 mg.", "Stop the pump before the film is opened!", "Dr. Keral wrote 17 notes."]
    target = ["务必先停泵，再打开薄膜！", "Keral博士写了17条笔记。", "薄膜上升了5 mg。"]
    frame = spark.createDataFrame(
        [("d", f"c{k}", "body", s, t) for k, (s, t) in enumerate(zip(source, [target[2], target[0], target[1]], strict=True))]
        + [("d", "u", "body", " ".join(source), "".join(target)), ("d", "one", "title", "The film", "薄膜"), ("d", "none", "body", "A film.", None), ("d", "no", "body", "A film.", "我无法翻译这段内容。"), ("d", "null", None, None, "薄膜。")],
        "doc_id string, unit_id string, unit_role string, source_text string, target_text string",
    )
    models = align_queries.Models(frame)
    found = {(r.source_start, r.target_start) for r in align_queries.aligned(frame, models).where("unit_id = 'u'").collect()}
    starts = [0, 23, 64]
    assert found == {(starts[0], 27), (starts[1], 0), (starts[2], 12)}
    assert {r.unit_id for r in align_queries.aligned(frame, models).collect()} == {"c0", "c1", "c2", "u", "one"}
    assert rows(align_queries.aligned(frame.limit(0), align_queries.Models(frame.limit(0)))) == []


def test_alignment_splits_as_the_sentence_query(spark):
    data = [("d", str(k), "body" if k % 2 else "abstract", f"Probe {k} rose at 7 p.m. Nobody left. It fell.", f"探针{k}上升。没有人离开。") for k in range(40)]
    frame = spark.createDataFrame(data + data, "doc_id string, unit_id string, unit_role string, source_text string, target_text string")
    models = align_queries.Models(frame, sample=10)
    assert models.boundaries.weights == sentences_queries.sentence_model(frame).weights
    assert models.finals.before == pairs_queries.finals_model(frame).before


def test_merged_windows_pair_both():
    singles = {(0, 0): 0.6, (1, 0): 0.4, (2, 1): 0.9}
    assert align.choose(singles, {(0, 0): 0.8, (1, 1): 0.5}, {}, 0.15, 0.02) == {(0, 0), (1, 0), (2, 1)}
    assert align.choose(singles, {(0, 0): 0.6}, {}, 0.15, 0.02) == {(0, 0), (2, 1)}


# 6


def test_ids_equal_a_public_encoder():
    tiktoken = pytest.importorskip("tiktoken")
    own = tokenize.encoder()
    other = tiktoken.Encoding("own", pat_str=tokenize.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    random.seed(3)
    texts = ["", "Hello world's  test\n\n x", "<|endoftext|>", "膜が水‍👩‍🔬 ١٢", "a" * 5000, LONG] + ["".join(chr(random.choice([*range(32, 127), *range(160, 400), *range(0x4E00, 0x4F00), 0x1F600])) for _ in range(50)) for _ in range(200)]
    assert own.encode_batch(pa.array([*texts, None], pa.string())).to_pylist() == [*[other.encode_ordinary(t) for t in texts], []]


def test_perfect_hash_is_minimal():
    keys = [f"k{i}".encode() for i in range(2000)]
    table = tokenize.PerfectHash(keys, list(range(2000)))
    assert sorted(table.keys) == sorted(keys)
    assert all(table.get(k) == i for i, k in enumerate(keys)) and table.get(b"other") == -1


def test_id_rows(spark):
    frame = spark.createDataFrame([(1, None), (2, ""), (3, "a b")], "doc_id long, text string")
    assert {r.doc_id: len(r.ids) for r in tokenize_queries.token_ids(frame.withColumn("ids", F.lit(1))).collect()} == {1: 0, 2: 0, 3: 2}
    assert tokenize_queries.token_ids(frame.limit(0)).collect() == []


# 7


def test_passages(spark):
    random.seed(4)
    words = [f"w{i}x" for i in range(60)]
    text = " ".join(words)
    replaced = [w if i not in (7, 20) else "other" for i, w in enumerate(words[:32])]
    shuffled = words[:40]
    random.shuffle(shuffled)
    chinese = "他们彩绘的木偶包裹了烟熏的提琴虽然另外生锈的石桥洗净了绯红的果园那位彩绘的枕头"
    cases = [(1, "xx " + "  ".join(words[5:20]).upper() + ", yy"), (2, " ".join(words[5:19])), (3, "-".join(replaced)), (4, " ".join(shuffled)), (5, None), (6, ""), (7, "前" + chinese[:10] + "，" + chinese[10:32] + "。"), (8, chinese[:29]), (9, LONG), (1, "xx " + "  ".join(words[5:20]).upper() + ", yy")]
    docs = spark.createDataFrame(cases, "doc_id long, text string")
    items = spark.createDataFrame([(10, "en", text), (11, "zh", chinese), (12, "en", None), (13, "en", text)], "item_id long, lang string, text string")
    found = {(r.doc_id, r.item_id): (r.span_start, r.span_end) for r in leaks_queries.leaks(docs, items).collect()}
    assert set(found) == {(1, 10), (1, 13), (3, 10), (3, 13), (7, 11)}
    a, b = found[1, 10]
    assert cases[0][1][a:b].lower().split() == words[5:20]
    assert rows(leaks_queries.leaks(docs, items.limit(0))) == []


def test_longest_passage():
    same = np.array([1] * 7 + [0] + [1] * 8 + [0] * 5, bool)
    assert leaks.longest(same, 15) == (0, 16)
    assert leaks.longest(same[:14], 15) is None


# 8


def brute(docs, least):
    held: dict[str, set] = {}
    for i, t in docs:
        for k in range(len(t) - least + 1):
            held.setdefault(t[k : k + least], set()).add(i)
    out = set()
    for i, t in docs:
        covered = sorted({p for k in range(len(t) - least + 1) if len(held[t[k : k + least]]) > 1 for p in range(k, k + least)})
        start = None
        for p, q in zip(covered, [*covered[1:], None], strict=False):
            start = p if start is None else start
            if q != p + 1:
                out.add((i, start, p + 1))
                start = None
    return sorted(out)


@pytest.mark.parametrize("hot", [2000, 2, 1])
def test_shared_spans_equal_brute_force(spark, hot, monkeypatch):
    monkeypatch.setattr(spans_queries, "HOT", hot)
    random.seed(5)
    words = ["".join(random.choices("abcdef", k=random.randint(1, 7))) for _ in range(200)]
    text = lambda n: " ".join(random.choices(words, k=n))
    common = [text(60) for _ in range(4)]
    docs = []
    for i in range(30):
        body = text(random.randint(0, 60)) + random.choice(["", *common])[: random.randint(100, 400)] + text(random.randint(0, 60))
        docs.append((i, body))
    notice = text(40)[:150]  # too short to be shared, and in many documents
    docs += [(50 + i, text(40) + notice + text(40)) for i in range(12)]
    docs += [(70 + i, text(20) + common[1] + text(20)) for i in range(6)]
    docs += [(30, docs[3][1]), (31, "ab" * 300), (32, "ab" * 200 + "c"), (33, common[0] + "x" + common[0]), (34, "水" * 250)]
    frame = spark.createDataFrame([*docs, docs[0], (40, None), (41, "")], "doc_id long, text string").withColumn("owner", F.lit("clash"))
    assert [tuple(r) for r in sorted(spans_queries.shared_spans(frame).collect())] == brute(docs, spans_queries.LEAST)
    assert spans_queries.shared_spans(frame.limit(0)).collect() == []


def test_index_equals_brute_force():
    random.seed(6)
    for _ in range(60):
        texts = ["".join(random.choices("abc", k=random.randint(1, 25))) for _ in range(random.randint(1, 7))]
        owners = np.asarray([random.randint(0, 3) for _ in texts])
        least = random.choice([1, 3, 5])
        index = fmindex.FMIndex([np.frombuffer(t.encode("utf-32-le"), np.uint32).astype(np.int64) for t in texts], owners)
        name, at = index.shared(np.arange(len(texts)), least)
        held: dict[str, set] = {}
        for k, t in enumerate(texts):
            for i in range(len(t) - least + 1):
                held.setdefault(t[i : i + least], set()).add(int(owners[k]))
        assert set(zip(name.tolist(), at.tolist(), strict=True)) == {(k, i) for k, t in enumerate(texts) for i in range(len(t) - least + 1) if len(held[t[i : i + least]]) > 1}


def test_chains_and_runs_of_any_length(mender):
    text = "at 5 °C now"
    for _ in range(6):
        text = text.encode().decode("latin_1")
    assert mender.damage(text)[1] == "at 5 °C now"
    assert mender.damage("中文".encode("gb18030").decode("cp1252"))[:2] == (True, "中文")
    assert mender.damage("Bréünoç größere ÖÐa") == (False, None, "")


def test_pairs_of_any_depth():
    text = "[（（（（（a. b] c. " + '"' + "(" * 80 + 'x. y" z.'
    _, closed = sentences.pairs_of(text)
    assert closed[0] == text.index("]")
    assert closed[text.index('"')] == text.rindex('"')


def test_longest_passage_equals_brute_force():
    random.seed(7)
    for _ in range(400):
        same = np.asarray([random.random() < 0.85 for _ in range(random.randint(1, 40))])
        least = random.choice([1, 5, 15])
        hits = np.flatnonzero(same)
        sizes = [b - a + 1 for a in hits for b in hits if b >= a and b - a + 1 >= least and 8 * int((~same[a : b + 1]).sum()) <= b - a + 1]
        found = leaks.longest(same, least)
        assert (found[1] - found[0] if found else 0) == max(sizes, default=0)


def test_items_in_blocks(spark, monkeypatch):
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(20))), (2, " ".join(f"v{i}" for i in range(20)))], "doc_id long, text string")
    items = spark.createDataFrame([(1, "en", " ".join(f"w{i}" for i in range(20))), (2, "en", " ".join(f"v{i}" for i in range(20)))], "item_id long, lang string, text string")
    monkeypatch.setattr(leaks_queries, "BLOCK", 1)
    assert {(r.doc_id, r.item_id) for r in leaks_queries.leaks(docs, items).collect()} == {(1, 1), (2, 2)}
