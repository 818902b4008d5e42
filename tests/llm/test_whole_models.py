"""Models are fitted on every row, not on a sample."""

import random

import pytest

from quirespark.llm import align_queries, mojibake, mojibake_queries, pairs, pairs_queries, sentences

UNIT = "doc_id string, unit_id string, unit_role string, source_text string, target_text string"


def test_finals_count_every_answer(spark):
    random.seed(8)
    texts = ["".join(random.choices("薄膜生长了12٣x。！？…", k=random.randint(0, 12))) for _ in range(3000)] + ["。", "。。", "长。", "了。长", "薄膜生长。"]
    frame = spark.createDataFrame([("d", str(k), "body", "A film grew", t) for k, t in enumerate(texts)] + [("d", "null", "body", "A film grew", None)], UNIT)
    whole = pairs.Finals.fit(t for t in texts if "。" in t)
    made = pairs_queries.finals_model(frame)
    kept = {k: n for k, n in whole.before.items() if n >= pairs.LEAST_BEFORE * whole.anywhere[k]}
    assert made.before == kept and made.anywhere == {k: whole.anywhere[k] for k in kept}
    assert all(made.ends(a + b) == whole.ends(a + b) for a in "薄膜生长了12x。！" for b in "薄膜生长了12x。！")


def test_rare_endings_count(spark):
    # each ending stands in one answer of 2 440, so that a sample of 2 000 lacks some
    rare = [chr(0x5000 + k) + "见" for k in range(40)]
    data = [("d", str(k), "body", f"Probe {k} rose.", f"探针{k}上升。") for k in range(2400)]
    data += [("d", f"rare {k}", "body", "It is rare.", f"此例{x}。") for k, x in enumerate(rare)] + [("d", f"open {k}", "body", "It is rare", f"此例{x}") for k, x in enumerate(rare)]
    frame = spark.createDataFrame(data, UNIT)
    assert pairs_queries.defective_pairs(frame, pairs_queries.finals_model(frame)).collect() == []


@pytest.mark.parametrize(("each", "fan"), [(1000, 32), (100, 2), (60, 32)])
def test_dictionaries_hold_what_any_text_repeats(spark, monkeypatch, each, fan):
    """Every text takes part: phrases that stand in some 60 of 1 500 texts each are in the dictionary, short and long texts alike."""
    monkeypatch.setattr(mojibake_queries, "FAN", fan)
    random.seed(9)
    word = lambda: "".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=random.randint(3, 9)))
    phrases = [" ".join(word() for _ in range(9)) for _ in range(25)]
    texts = [f"{word()} {word()} {phrases[k % 25]} {word()}" for k in range(1500)] + ["word " * 20_000]
    frame = spark.createDataFrame([(k, t, "EN" if k % 2 else "en") for k, t in enumerate(texts)] + [(-1, None, "en"), (-2, "", "en"), (-3, "x", None)], "doc_id long, text string, lang string")
    made = mojibake_queries.dictionaries(frame, each)
    assert set(made) == {"en"} and len(made["en"]) <= mojibake.SIZE
    assert sum(p.encode() in made["en"] for p in phrases) >= 20
    assert made == mojibake_queries.dictionaries(frame.repartition(7), each)


def test_dictionaries_see_every_text(spark, monkeypatch):
    monkeypatch.setattr(mojibake_queries, "train", lambda samples: b"|".join(samples))
    monkeypatch.setattr(mojibake_queries, "merge", lambda parts: b"|".join(parts))
    long = "".join(chr(0x4E00 + k % 19_000) for k in range(45_000))
    texts = [f"text {k} of many, each of them with words of its own and none left out of all" for k in range(900)] + ["short", long]
    frame = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts * 2)], "doc_id long, text string, lang string")
    seen = mojibake_queries.dictionaries(frame, 50)["en"].decode().split("|")
    assert sorted(seen) == sorted([*texts[:-1], *(long[k : k + 20_000] for k in (0, 20_000, 40_000))])


def test_boundaries_and_finals_of_alignment_count_every_text(spark):
    # each word before a mark stands in three texts of 2 520, so that a sample of 2 000 units lacks some
    words = ["word" + chr(97 + k % 26) + chr(97 + k // 26) for k in range(40)]
    data = [("d", str(k), "body", f"Probe {k} rose at 7 p.m. Nobody left. It fell.", f"探针{k}上升。没有人离开。") for k in range(2400)]
    data += [("d", f"{w} {k}", "body", f"Note {k} has {w}. Others have none.", f"注{k}有{chr(0x5000 + n)}见。其余没有。") for n, w in enumerate(words) for k in range(3)]
    models = align_queries.Models(spark.createDataFrame([*data, ("d", "null", "body", None, None)], UNIT), sample=10, concepts=10)
    assert models.boundaries.weights == sentences.train({t for r in data for t in r[3:]}).weights
    assert all(f"token={w}" in models.boundaries.weights for w in words)
    assert all(chr(0x5000 + n) + "见" in models.finals.before for n in range(40))
