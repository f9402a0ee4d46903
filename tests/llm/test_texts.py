"""Encoding, packing, quality, languages, pairs and sentences: round trips, held-out labels, odd input."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuemill.llm import broken_pairs as B
from cuemill.llm import encoding as E
from cuemill.llm import languages as L
from cuemill.llm import packing as P
from cuemill.llm import sentences as S
from cuemill.llm import text_quality as Q
from cuemill.llm.queries import ORACLE, QUERIES
from cuemill.session import table
from tests.conftest import data

TEXTS = ["hello world", "", None, "你好，世界 🎧", "a\r\n\r\n  b\t", "=-" * 3000, "हिन्दी और ไทย", "<|endoftext|>", "x" * 20_000, "hello world"]


def texts(spark):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "doc_id bigint, text string, key string")


def test_encoding(spark):
    tiktoken = pytest.importorskip("tiktoken")
    tokens = E.read_ranks(E.tokenizer_path())
    other = tiktoken.Encoding("own", pat_str=E.pretoken_pattern(), mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    got = {r.doc_id: r.ids for r in E.encode_texts(texts(spark), "doc_id", "text").collect()}
    assert got == {i: other.encode_ordinary(t) if t else [] for i, t in enumerate(TEXTS)}
    assert all(E.decode(tokens, got[i]) == (t or "") for i, t in enumerate(TEXTS))
    assert E.encode_texts(texts(spark).limit(0), "doc_id", "text").count() == 0


def test_ascii_pattern():
    """The standard library's pattern matches the same in ASCII texts, controls included."""
    import re

    import regex

    public, own = regex.compile(E.pretoken_pattern()).findall, re.compile(E.ascii_pattern(E.pretoken_pattern())).findall
    random.seed(2)
    for _ in range(3000):
        text = "".join(random.choice("ab' s12\n\t\x1c.") if random.random() < 0.5 else chr(random.randrange(128)) for _ in range(40))
        assert own(text) == public(text)
    assert E.ascii_pattern(r"[\S]") is None and E.ascii_pattern(r"\bx") is None


def test_memory_of_encoders(monkeypatch):
    """An encoder that forgets gives the same ids."""
    tokens = [bytes([b]) for b in range(256)] + [b"ab", b" ab"]
    encoder = E.Encoder(E.bpe_model(tokens), E.pretoken_pattern())
    texts = ["ab ab", None, "é 你好 ab", "x" * 100, "ab"]
    wanted = encoder.batch_ids(texts).to_pylist()
    monkeypatch.setattr(E, "MEMORY", 2)
    assert [encoder.batch_ids(texts).to_pylist() for _ in range(3)] == [wanted] * 3 and encoder.ids("ab ab") == wanted[0] == [256, 257]


def test_index_without_used_items():
    """Leaving used items out of the index changes no score of the others."""
    random.seed(3)
    items = [P._terms(np.array([random.randrange(40) for _ in range(12)], np.int32)) for _ in range(50)]
    whole, less = (P.Index([t for t, _ in items], [c for _, c in items]) for _ in range(2))
    free = np.array([random.random() < 0.5 for _ in items])
    less.keep(free)
    less.keep(free)
    for seed in range(50):
        assert np.array_equal(np.where(free, whole.scores(seed), 0), less.scores(seed))


def test_best_subset():
    random.seed(3)
    for _ in range(50):
        sizes = [random.randint(1, 30) for _ in range(8)]
        best = max(sum(s for s, b in zip(sizes, f"{m:08b}", strict=True) if b == "1") for m in range(256) if sum(s for s, b in zip(sizes, f"{m:08b}", strict=True) if b == "1") <= 60)
        assert sum(sizes[i] for i in P.best_subset(sizes, 60)) == best


@pytest.mark.parametrize("shard_items", [2, 4096])
def test_packing(spark, shard_items):
    rows = P.pack_documents(texts(spark), "doc_id", "text", capacity=50, shard_items=shard_items).collect()
    sizes = {r.doc_id: len(r.ids) for r in E.encode_texts(texts(spark), "doc_id", "text").collect()}
    used: dict = {}
    pieces: dict = {}
    for r in rows:
        used[r.container_id] = used.get(r.container_id, 0) + r.n_tokens
        pieces.setdefault(r.doc_id, []).append((r.start_token, r.n_tokens))
    assert max(used.values()) <= 50 and set(pieces) == set(sizes)
    for key, parts in pieces.items():
        assert len(parts) == 1 if sizes[key] <= 50 else len(parts) == -(-sizes[key] // 50)
        assert [p[0] for p in sorted(parts)] == [50 * i for i in range(len(parts))] and sum(p[1] for p in parts) == sizes[key]
    assert P.pack_documents(texts(spark).limit(0), "doc_id", "text", capacity=50).count() == 0


def test_packing_fills(spark):
    documents = table(spark, data("sf0.01"), "documents")
    rows = P.pack_documents(documents, "doc_id", "text", capacity=2048).groupBy("container_id").agg(F.sum("n_tokens").alias("n")).collect()
    assert sum(r.n for r in rows) / (2048 * len(rows)) > 0.985


def test_packing_whatever_the_partitions(spark):
    """How the input is split and ordered changes nothing."""
    documents = table(spark, data("sf0.01"), "documents").select("doc_id", "text")
    pack = lambda frame: sorted(map(tuple, P.pack_documents(frame, "doc_id", "text", capacity=512, shard_items=200).collect()))
    assert pack(documents.repartition(3, "doc_id")) == pack(documents.orderBy(F.desc("doc_id")).repartition(7))


def test_packing_neighbours(spark):
    """The neighbours of a document's shard are nearly as near as the nearest of all, and mostly these."""
    documents = table(spark, data("sf0.01"), "documents")
    shared = E.shared_model(documents)
    centroids = P.fit_centroids(documents.select(F.col("doc_id").cast("string").alias("key"), "text"), shared, 2048, 1000, 64)
    rows = E.encode_texts(documents, "doc_id", "text").where("size(ids) > 0").orderBy("doc_id").collect()
    items = [P._terms(np.array(r.ids[:2048], np.int32)) for r in rows]
    buckets = [centroids.bucket(*item) for item in items]
    known, shards = P.shards_of_buckets(Counter(buckets), 256)
    first = {bucket: shard for bucket, shard, _ in known}
    shard = np.array([first[b] for b in buckets])
    index = P.Index([t for t, _ in items], [c for _, c in items])
    near, nearest, met = 0.0, 0.0, 0
    for seed in range(0, len(items), 10):
        score = index.scores(seed)
        score[seed] = -1
        inside = np.where(shard == shard[seed], score, -1)
        best, mine = np.sort(score)[::-1][:10], np.sort(inside)[::-1][:10]
        near, nearest, met = near + mine.clip(0).sum(), nearest + best.sum(), met + (mine >= best[-1]).sum()
    assert shards >= 4 and near >= 0.95 * nearest and met >= 0.75 * len(items)


def test_shards_of_buckets():
    known, shards = P.shards_of_buckets({0: 3, 1: 4, 5: 25, 7: 10, 9: 1}, 10)
    assert known == [(0, 0, 1), (1, 0, 1), (5, 1, 3), (7, 4, 1), (9, 5, 1)] and shards == 6
    assert P.shards_of_buckets({}, 10) == ([], 0)


def test_encoders_of_vocabularies(spark):
    """Vocabularies of the same size in one worker have an encoder each."""
    import os
    import tempfile
    from base64 import b64encode

    got = []
    for pair in (b"ab", b"bc"):
        path = os.path.join(tempfile.mkdtemp(), "v.tiktoken")
        with open(path, "wb") as out:
            out.writelines(b64encode(t) + b" " + str(i).encode() + b"\n" for i, t in enumerate([*(bytes([b]) for b in range(256)), pair]))
        got.append(E.encode_texts(spark.createDataFrame([(1, "abc")], "doc_id int, text string").coalesce(1), "doc_id", "text", path=path).first().ids)
    assert got == [[256, 99], [97, 256]]


def test_quality(spark):
    folder = data("sf0.01")
    types = Q.text_types(table(spark, folder, "documents"), table(spark, folder, "common_words"))
    pairs = types.join(table(spark, folder, "quality_labels").withColumnRenamed("text_class", "label"), "doc_id").collect()
    assert sum(r.text_class == r.label for r in pairs) >= 0.97 * len(pairs)
    odd = Q.text_types(texts(spark), table(spark, folder, "common_words"))
    assert {r.doc_id for r in odd.collect()} == {i for i, t in enumerate(TEXTS) if t}
    assert Q.text_types(texts(spark).limit(0), table(spark, folder, "common_words")).count() == 0
    assert Q.quality_statistics(texts(spark), table(spark, folder, "common_words")).where("doc_id = 0").first().n_words == 2


@pytest.mark.parametrize("mark", ["\t", " | ", ";", "   ", " ..... ", ","])
def test_tables_under_a_title(mark):
    """Columns count wherever they start, be it below a title, a source and a date."""
    rows = ["Gauge readings", "Harbour office", "Spring", *(mark.join([f"station {i}", "north", str(i * 7)]) for i in range(40))]
    values = Q.statistics("\n".join(rows), frozenset(), Q.common_pattern([])[1])
    assert values["column_share"] == pytest.approx(40 / 43) and values["number_cell_share"] == pytest.approx(40 / 43)


def test_one_thing_repeated():
    """A sentence repeated a thousand times is one thing, however long it is; different rows aren't."""
    pattern = Q.common_pattern([])[1]
    sentence = "The old mill by the river is gone, and nobody in the town is surprised at all, not even the miller. "
    assert Q.statistics(sentence * 1000, frozenset(), pattern)["variety"] <= 0.12
    rows = "\n".join(f"station {i}; north; {i * i * 7919 % 99991}" for i in range(3000))
    assert Q.statistics(rows, frozenset(), pattern)["variety"] > 0.12


def test_languages(spark):
    folder = data("sf0.01")
    documents = table(spark, folder, "documents")
    model = L.train_on(documents, sample=600)
    said = {"en": "The old mill is gone, and nobody is surprised at all.", "de": "Die alte Mühle ist weg, und niemand ist überrascht.", "fr": "Le vieux moulin a disparu et personne n'est surpris.", "es": "El viejo molino ya no está y nadie se sorprende.", "zh": "旧磨坊真的不见了，谁也不觉得意外。", "ja": "古い水車小屋は本当になくなったのですか。", "ru": "Старая мельница исчезла, и никто не удивлён.", "ar": "اختفت الطاحونة القديمة ولا أحد يتفاجأ.", "hi": "पुरानी चक्की गायब है और कोई हैरान नहीं है।", "th": "โรงสีเก่าหายไปและไม่มีใครแปลกใจ"}
    found = L.classify([*said.values(), "", "12 34"], model)
    assert [L.LANGUAGES[i] for i in found.language[:10]] == list(said)
    assert found.language[10] == found.language[11] == -1 and found.size[10] == 0
    # held out: documents outside the training sample, against their script
    parts = L.item_parts(documents, table(spark, folder, "cues").limit(0), table(spark, folder, "transcripts").limit(0), model)
    thai = parts.join(documents.select(F.col("doc_id").alias("item_id"), "text"), "item_id").where("text rlike '^[\\\\x{e00}-\\\\x{e7f} ]+$'").collect()
    assert thai and all(r.lang == "th" for r in thai)
    assert L.blocks("a\r\n\r\nb\n \n\n c") == ["a", "b", " c"] and L.blocks(None) == []
    empty = L.item_parts(documents.limit(0), table(spark, folder, "cues").limit(0), table(spark, folder, "transcripts").limit(0), model)
    assert empty.count() == 0 and L.main_languages(empty).count() == 0


def test_main_and_foreign_parts(spark, monkeypatch):
    """Items of many blocks, rejected parts and ties, without any join on the item alone."""
    monkeypatch.setattr(L, "BLOCK", 4)

    def cosines(**near):
        return bytearray(np.array([near.get(code, 0.0) * L.FINE for code in L.LANGUAGES]).astype(">u2").tobytes())

    en, ru = cosines(en=0.9, ru=0.1), cosines(en=0.1, ru=0.9)
    rows = [("file", 1, i, "en", 0.8, 50, en) for i in range(20)] + [("file", 1, 21, "ru", 0.9, 50, ru), ("file", 1, 22, None, 0.5, 50, en)]
    rows += [("document", 2, 1, None, 0.5, 9, en), ("document", 3, 1, "ru", 0.9, 30, ru), ("document", 3, 2, "en", 0.7, 30, en), ("document", 4, 1, "en", 0.75, 9, en)]
    parts = spark.createDataFrame(rows, "item_type string, item_id bigint, part_no bigint, lang string, confidence float, size int, cosines binary")
    mains = L.main_languages(parts)
    got = {(r.item_type, r.item_id): (r.main, round(r.confidence, 4)) for r in mains.collect()}
    assert got == {("file", 1): ("en", round(20 * 0.8 / 22, 4)), ("document", 2): (None, 0.0), ("document", 3): ("en", 0.35), ("document", 4): ("en", 0.75)}
    foreign = L.foreign_parts(parts, mains)
    assert sorted((r.item_id, r.part_no, r.lang) for r in foreign.collect()) == [(1, 21, "ru"), (3, 1, "ru")]
    labels = spark.createDataFrame([("document", 2, "fr"), ("document", 3, "EN"), ("document", 4, "de")], "item_type string, item_id bigint, label string")
    assert [r.item_id for r in L.label_cases(mains, labels).collect()] == [4]
    joins = [line for line in foreign._jdf.queryExecution().sparkPlan().toString().split("\n") if "Join" in line]
    assert joins and all("blk" in line for line in joins)


STOPWORDS = {"the": ["en"], "is": ["en"], "and": ["en"], "der": ["de"], "ist": ["de"], "und": ["de"], "le": ["fr"], "est": ["fr"], "el": ["es"], "y": ["es"]}


@pytest.mark.parametrize(
    ("op", "source", "answer", "label", "defect"),
    [
        ("translate", "The kiln is gone and the mill is old.", None, "German", "empty"),
        ("translate", "The kiln is gone.", "```\n```", "German", "empty"),
        ("translate", "The kiln is gone.", "Translation:", "German", "empty"),
        ("translate", "", " ", "German", None),
        ("translate", "20.035 / 22", "20.035 / 22", "German", None),
        ("translate", "Sorry, I cannot show the kiln yet.", "Der Ofen ist noch nicht da, und ich kann es nicht.", "German", None),
        ("translate", "The kiln is gone and the mill is old.", "I'm sorry, but I can't help with that request.", "German", "refusal"),
        ("translate", "The kiln is gone and the mill is old.", "作为一个助手，我不能处理这段内容。", "Chinese", "refusal"),
        ("translate", "The kiln is gone and the mill is old.", "GERMAN:\nTHE KILN IS GONE AND THE MILL IS OLD", "German", "copy"),
        ("translate", "The kiln is gone and the mill is old.", "Le four est vieux et le moulin est là.", "German", "wrong_language"),
        ("translate", "The kiln is gone.", "窑不见了。", "Klingon", None),
        ("rewrite", "uh the kiln is gone um and the mill is old", "The kiln is gone and the mill is old.", "English", None),
        ("rewrite", "uh the kiln is gone um and the mill is old", "uh the kiln is gone um and the mill is old.", "English", "copy"),
        ("rewrite", "uh the kiln is gone and the mill is old and the loom is here and the lamp is lit", "The kiln is gone and", "English", "truncated"),
        ("translate", None, "Der Ofen ist alt.", None, None),
    ],
)
def test_pairs(op, source, answer, label, defect):
    assert B.judge(op, source, answer, label, STOPWORDS, {}) == defect


@pytest.mark.parametrize(
    ("source", "answer", "defect"),
    [
        ("The kiln is gone. The mill is old, and the loom is 3.5 m wide.", "the kiln is gone the mill is old and the loom is 3.5 m wide", "copy"),
        ("The kiln is gone. The mill is old, and the loom is wide.", "The kiln is gone. The mill is old, and loom is wide.", "copy"),
        ("The kiln is gone. The mill is old, and the loom is wide.", "The kiln is gone. The mill is odl, and the loom is wide.", "copy"),
        ("the kiln is gone", "THE KILN IS GONE", "copy"),
        ("the kiln is gone and old", "the kiln is gnoe and old", "copy"),
        ("窑不见了，磨坊很旧。", "窑不见了磨坊很旧", "copy"),
        ("the kiln is 3.5 m wide and the mill is old and the loom is here", "the kiln is 3.5 m wide and the mill is old and the loom is here", "copy"),
        ("the kiln is gone", "The kiln is gone.", None),
        ("the kiln is gone the mill is old", "The kiln is gone. The mill is old.", None),
        ("窑不见了磨坊很旧", "窑不见了，磨坊很旧。", None),
        ("The kiln is is gone. The mill is old.", "The kiln is gone. The mill is old.", None),
        ("3.5 / 22", "3.5 / 22", None),
        ("The kiln is gone. The mill is old.", "We lost the kiln, and the mill has aged.", None),
    ],
)
def test_copies_without_fillers(source, answer, defect):
    assert B.fillers_in(source) == 0 and B.judge("rewrite", source, answer, None, STOPWORDS, {}) == defect


LONG_REFUSAL = (
    "I'm sorry, but I can't help with that request. The passage you sent touches on matters that I have been asked to stay away from, and I take that seriously. "
    "I am not permitted to process material of this kind, whether as a draft, a summary or a full version in another language. "
    "Please don't take it as a judgement of the author. If you have a different paragraph, say one about gardens, weather or travel, I would gladly look at it. "
    "Unfortunately, for this passage no version can be given, and trying again with the same lines would not change the outcome."
)
QUOTING = (
    "Am Morgen ging die Gruppe zum Hafen, wo der alte Kran stand und die Boote lagen. Der Lotse zeigte ihnen die Karte, die er im Winter gezeichnet hatte, und sprach von der Strömung. "
    "„Ich kann Ihnen nicht helfen“, sagte der Wirt später. Danach liefen sie über die Brücke zum Turm, zählten die Stufen und schrieben alles in das Heft, das die Lehrerin mitgebracht hatte. "
    "Der Himmel wurde dunkel, und der Wind drehte nach Norden. Am Abend saßen alle am Ofen und hörten der Geschichte vom Müller zu, der sein Rad verlor."
)


def test_long_refusals():
    source = "Le four a disparu et le moulin est vieux."
    assert len(LONG_REFUSAL) > 420 and B.judge("translate", source, LONG_REFUSAL, "German", STOPWORDS, {}) == "refusal"
    assert len(QUOTING) > 420 and B.refusal_points(QUOTING.replace("Ich kann Ihnen nicht helfen", "Das ist nicht erlaubt")) >= 2
    assert not B.is_refusal(QUOTING.replace("Ich kann Ihnen nicht helfen", "Das ist nicht erlaubt"), source)
    thai = "กาดำบินไปที่ท่าเรือแล้วนกน้อยมาดูปลาว่ายไป " * 20
    assert not B.is_refusal(thai + "ไม่ได้รับอนุญาต" + thai, source)


def test_learned_refusals(spark):
    """Of the refusals that only left-out phrases know, learned ones find a part, and no sound answers."""
    rows = B.pairs_of(table(spark, data("sf0.1"), "translations"), table(spark, data("sf0.1"), "para_rewrites")).where("answer is not null").select("source", "answer").distinct().collect()
    pairs = [(r.source, r.answer) for r in rows]
    texts = [(B._squeezed(s or ""), B._squeezed(B.unwrapped(a))) for s, a in pairs]
    every = [B.is_refusal(a, s) for s, a in texts]
    whole, known = B.REFUSALS, list(B._AUTOMATA)
    try:
        random.seed(1)
        B.REFUSALS = {n: [p for p in phrases if random.random() < 0.5] for n, phrases in whole.items()}
        B._AUTOMATA.clear()
        half = [B.is_refusal(a, s) for s, a in texts]
        learned = B.automaton_of(B.learn_refusals(pairs))
        told = [B.is_refusal(a, s, learned) for s, a in texts]
    finally:
        B.REFUSALS, B._AUTOMATA[:] = whole, known
    unseen = [t for t, e, h in zip(told, every, half, strict=True) if e and not h]
    assert len(unseen) > 30 and sum(unseen) >= 0.15 * len(unseen)
    assert sum(t and not e for t, e in zip(told, every, strict=True)) <= 0.01 * sum(every)
    assert B.learn_refusals([]) == [] and B.automaton_of([]) is None


def test_refusals_are_learned_from_all_pairs(spark):
    """Five refusals among 60 000 pairs teach their other words, and usual lengths are exact medians."""
    pairs = spark.range(60_000).select(F.lit("translate").alias("op"), F.col("id").alias("pair_id"), F.concat(F.lit("Der Ofen "), "id").alias("source"), F.concat(F.lit("The kiln "), "id").alias("answer"), F.lit("English").alias("label"))
    declining = "The quorn of this brolk stays glimbed, so the frawn must wend."
    known = spark.range(60_000, 60_005).select(F.lit("translate"), "id", F.lit("Der Ofen"), F.lit("I am unable to help with that, and I must decline this one. " + declining), F.lit("English"))
    told = spark.range(60_005, 60_006).select(F.lit("translate"), "id", F.lit("Der Ofen"), F.lit(declining), F.lit("English"))
    got = {(r.pair_id, r.defect) for r in B.broken_pairs(pairs.union(known).union(told), spark.createDataFrame([("en", "the")], "lang string, word string")).where("pair_id >= 60000").collect()}
    assert got == {(i, "refusal") for i in range(60_000, 60_006)}
    ratios = spark.range(200_001).select(F.lit("x").alias("op"), F.lit("de").alias("language"), F.lit("en").alias("target"), (F.col("id") / 7).alias("ratio"))
    assert [r.median for r in B.usual_ratios(ratios).collect()] == [100_000 / 7]


@pytest.mark.parametrize("at_a_time", [7, 200_000])
def test_learning_over_a_table(spark, monkeypatch, at_a_time):
    """A table, rows given twice, teaches the phrases that a list teaches; those left out cover nothing more."""
    monkeypatch.setattr(B, "CANDIDATES", at_a_time)
    random.seed(4)
    words = ["mill", "kiln", "river", "stone", "old", "gone"]
    pairs = [(" ".join(random.choices(words, k=6)), " ".join(random.choices(words + ["brolk", "quorn"], k=6))) for _ in range(300)]
    for other in ("the quorn of this brolk", "quorn of frawn wend", "this brolk stays glimbed"):
        pairs += [("old mill", f"i cannot help with that {other}")] * 4 + [("old stone", f"{other} {other} now")]
        pairs += [("old kiln", f"{other} stays here now")]
    rows = [("rewrite", str(i), s, a, B.is_refusal(a, s), True) for i, (s, a) in enumerate(pairs)]
    table = spark.createDataFrame(rows + rows[-30:], "op string, pair_id string, source string, plain string, refused boolean, open boolean")
    wanted = B.learn_refusals(pairs)
    phrases, told = B.learn_from(table)
    every, few = B.automaton_of(wanted), B.automaton_of(phrases)
    assert set(phrases) <= set(wanted) and len(phrases) > 3
    assert all(B.covered(a, every) == B.covered(a, few) for _, a in pairs)
    assert {r.pair_id for r in told.collect()} == {str(i) for i, (s, a) in enumerate(pairs) if not B.is_refusal(a, s) and B.is_refusal(a, s, every)} != set()
    assert B.learn_from(table.where("not refused")) == ([], None)


def test_copied_share():
    random.seed(8)
    for _ in range(200):
        source = "".join(random.choice("abc") for _ in range(60))
        answer = "".join(random.choice("abcd") for _ in range(30))
        for share in (0.1, 0.5, 0.9):
            assert B.is_copied(source, answer, share, 3) == (B.copied_share(source, answer, 3) >= share)
    assert B.copied_share("", "a") == B.copied_share("a", "") == 0.0


def test_suffix_automaton():
    random.seed(5)
    for _ in range(100):
        source = "".join(random.choice("abc") for _ in range(40))
        answer = "".join(random.choice("abcd") for _ in range(20))
        brute = sum(any(i <= k < j and j - i >= 4 and answer[i:j] in source for i in range(20) for j in range(i + 1, 21)) for k in range(20))
        assert B.SuffixAutomaton(source).copied(answer, 4) == brute


def test_pair_frames(spark):
    words = spark.createDataFrame([("en", "the"), (None, "x")], "lang string, word string")
    rows = spark.createDataFrame([("translate", 1, "a b", None, "German", 0), ("translate", 1, "a b", None, "German", 0), ("rewrite", 2, None, None, None, 1)], "op string, pair_id bigint, source string, answer string, label string, defect int")
    assert sorted((r.op, r.pair_id, r.defect) for r in B.broken_pairs(rows, words).collect()) == [("rewrite", 2, "empty"), ("translate", 1, "empty")]
    assert B.broken_pairs(rows.limit(0), words).count() == 0


@pytest.mark.parametrize(
    "units",
    [
        ["Dr. Velm explained it at 9 a.m. on Monday.", "See Fig. 83 and No. 8, where v1.2 is shown.", "Is it gone?!"],
        ['"Is it ready? Not yet." said Velm.', 'Osrin wrote: "Work is done."', "Maybe it is enough...", "ffmpeg reads a.mp4 at 5.8 fps."],
        ["The mill (it was late. very late.) stood here.", "It is the best... or almost.", "The end."],
        ["“陶罐准备好了吗？还没有。”哈斯品说。", "诺尔维写道：“工作已经做完了。”", "这里最重要的……或者差不多。", "就够了……"],
        ["「準備はできたか。まだです。」とヴェルムさんが言いました。", "エロリーさんは「作業は終わりました。」と書きました。"],
        ["Laut Dr. Osrin war es d. h. zu früh.", "Es geht um Chor, Halle usw.", "Die Arbeit ist getan."],
        ["Tarkel a écrit : « Tout est prêt. »", "La séance parle de musique, etc. et ainsi de suite."],
        ["Uh... maybe it is enough.", "SPEAKER_01: Hm, it is."],
    ],
)
def test_sentences(units):
    glue = "" if units[0][-1] >= "⺀" or units[0][0] in "“「" else " "
    text = glue.join(units)
    assert [text[a - 1 : b] for a, b in S.sentence_spans(text)] == units


def test_sentences_odd(spark):
    assert S.sentence_spans(None) == S.sentence_spans("") == S.sentence_spans(" \n ") == []
    assert S.sentence_spans("# Title\nOne\ntwo.\r\n\r\nThree") == [(1, 7), (9, 16), (21, 25)]
    long = "This is a sentence. " * 5000
    assert len(S.sentence_spans(long)) == 5000
    random.seed(9)
    for _ in range(200):
        text = "".join(random.choice("aB .。？\"“”()（）\n…!字ไ1") for _ in range(60))
        at = 0
        for a, b in S.sentence_spans(text):
            assert a > at and b >= a and text[a - 1 : b] == text[a - 1 : b].strip() and not text[at : a - 1].strip()
            at = b
        assert not text[at:].strip()
    frame = spark.createDataFrame([(1, "A bee. C dee.", 5), (2, None, 5), (1, "A bee. C dee.", 5)], "item_id bigint, content string, unit_no int")
    assert S.sentence_units(frame, S.NO_GAPS, ["item_id"], "content").count() == 4


def test_long_quotations():
    """Sentences within a quotation don't end the one around them, however long the quotation is
    and however far before them another one within it."""
    text = "She wrote: “The mill (the old one) is gone. " + "The old mill is gone. " * 300 + "Nobody came.” Then she left."
    assert len(S.sentence_spans(text)) == 2
    text = "The note (“No!” it said, " + "it was late. It rained; " * 300 + "all slept) was short. Then she left."
    assert len(S.sentence_spans(text)) == 2


def test_word_lattice():
    """The path through the lattice is the cheapest of all ways to cut a text at whole letters."""
    random.seed(4)
    for _ in range(60):
        costs = {"": 9.0} | {"".join(random.choice(["กา", "ดำ", "น", "ปลา"]) for _ in range(random.randint(1, 3))): random.uniform(1, 8) for _ in range(6)}
        run = "".join(random.choice(["กา", "ดำ", "น", "ป", "ลา"]) for _ in range(7))
        ends = [0, *S._thai_letters(run)]

        def cheapest(i, ends=ends, run=run, costs=costs):
            if i == len(ends) - 1:
                return 0.0
            return min(cheapest(j) + (costs.get(run[ends[i] : ends[j]], 9.0 if j == i + 1 else math.inf) if j > i + 1 else min(9.0, costs.get(run[ends[i] : ends[j]], 9.0))) for j in range(i + 1, len(ends)) if ends[j] - ends[i] <= S.LONGEST or j == i + 1)

        words = S.words_of(run, costs)
        whole = set(S._thai_letters(run)) | {0}
        assert "".join(words) == run and all(sum(map(len, words[:k])) in whole for k in range(len(words)))
        assert sum(costs.get(w, 9.0) if w != "" else 9.0 for w in words) == pytest.approx(cheapest(0))
    assert S.words_of("", {}) == [] and S.words_of("เกาะ", {}) == ["เกาะ"]


def test_learned_words(spark):
    """Words learned from texts without spaces cut other texts of these words at nine in ten places."""
    random.seed(6)
    letters = [c + v for c in "กขคงจชดตทนบปพมยรลวสห" for v in ("", "า", "ี", "ู")]
    words = ["".join(random.choice(letters) for _ in range(random.randint(2, 3))) for _ in range(60)]
    said = ["".join(random.choice(words) for _ in range(6)) for _ in range(400)]
    costs = S.learn_words(spark.createDataFrame([(t,) for t in said], "text string"), ["ครับ"])
    assert "ครับ" in costs and len(costs) <= S.LONGEST / S.RAREST
    met = total = 0
    for _ in range(100):
        true = [random.choice(words) for _ in range(6)]
        found = S.words_of("".join(true), costs)
        places = lambda ws: {sum(map(len, ws[:k])) for k in range(1, len(ws))}
        met += len(places(true) & places(found))
        total += len(places(true) | places(found))
    assert met >= 0.9 * total


def test_gaps_of_all_entries(spark):
    """Few texts, and entries that begin or end one text only, count as all others do."""
    said = ["กาดำบินไป กาดำบินมา", "กาดำกินปลา นกน้อยมาดู", "นกน้อยบินมา ปลาว่ายไป กาดำบินไป"]
    gaps = S.learn_gaps(spark.createDataFrame([(t,) for t in said], "text string"))
    after, before, begin, end, n_gaps = Counter(), Counter(), Counter(), Counter(), 0
    for text in said:
        begin.update(S._forms(S._near_gap("", text, gaps.words)[1]))
        end.update(S._forms(S._near_gap(text, "", gaps.words)[0]))
        for i in (i for i, c in enumerate(text) if c == " "):
            left, right = S._near_gap(text[:i], text[i + 1 :], gaps.words)
            after.update(S._forms(right))
            before.update(S._forms(left))
            n_gaps += 1
    share = 1 / (1 + math.exp(gaps.prior))

    def likely(entry, seen, edge):
        shorter = "".join(f"{w}|" for w in entry.split("|")[:-2])
        short = likely(shorter, seen, edge) if shorter else share
        return (min(seen[entry], share * n_gaps * edge[entry] / len(said)) + S.SMOOTHING * short) / (seen[entry] + S.SMOOTHING)

    for seen, edge, known in [(after, begin, gaps.openings), (before, end, gaps.endings)]:
        assert known and set(known) <= set(seen)
        for entry, odds in known.items():
            p = min(0.99, max(0.01, likely(entry, seen, edge)))
            assert odds == pytest.approx(math.log(p / (1 - p)))
    assert S.learn_gaps(spark.createDataFrame([], "text string")) == S.learn_gaps(spark.createDataFrame([("กาดำบินไป",)], "text string")) == S.NO_GAPS
    units = ["กาดำบินไป", "นกน้อยมาดู", "ปลาว่ายมา", "เรือแล่นไป"]
    gaps = S.learn_gaps(spark.createDataFrame([(f"{a} {b}",) for a in units for b in units if a != b], "text string"))
    assert [S.sentence_spans(f"{a} {b}", gaps) for a, b in zip(units, units[1:], strict=False)] == [[(1, len(a)), (len(a) + 2, len(a) + 1 + len(b))] for a, b in zip(units, units[1:], strict=False)]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_run(spark, name):
    frame = QUERIES[name](spark, data("sf0.01" if name.startswith("p6") else "sf0.001"))
    assert frame.count() > 0
    if name.endswith("_found"):
        assert frame.count() == frame.distinct().count()


def test_oracle_names():
    assert set(ORACLE) <= set(QUERIES)
