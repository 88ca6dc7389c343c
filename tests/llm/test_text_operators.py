"""Operators on documents against plain Python on small tables with edge cases."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from fieldloom.llm import decontaminate, language_id, mixing, near_duplicates, recurrent_lm, substring_dedup
from fieldloom.llm.components import connected_components

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
SPACED = re.compile(rb"[^\x20\x09-\x0D]+")
ALNUM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, node string, key bigint"


def spaced(text, lower=False):
    raw = (text or "").encode()
    return SPACED.findall(raw.translate(LOWER) if lower else raw)


def alnum(text):
    return ALNUM.findall((text or "").encode().translate(LOWER))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    words = [w + str(i) for i in range(60) for w in ("ab", "Çd", "e")]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared, passage = line(45), line(25)
    texts = [line(rng.randint(1, 90)) for _ in range(25)]
    texts += [texts[0], texts[0], texts[1].upper(), texts[2] + " more", texts[2] + " tail " + shared, shared + "\n" + texts[3], "x " + shared, passage + " " + passage, passage]
    for k in range(12):  # near copies of one text
        own = texts[4].split() * 2
        for _ in range(k // 3):
            own[rng.randrange(len(own))] = "new%d" % rng.randrange(99)
        texts.append(" ".join(own))
    texts += [None, "", " \n\t ", "one", "ONE", "two words", "é", "a\x0bb", "w" * 5000, line(3000), "- - 123 !!"]
    rows = [(i, t, None if i % 7 == 0 else "l%d" % (i % 2), None if i % 11 == 0 else "s%d" % (i % 4), None if t is None else len(t), "clash", i) for i, t in enumerate(texts)]
    rows += [rows[3], (None, texts[5], "l0", "s1", 1, None, 2), (None, None, None, None, None, None, None)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def as_rows(frame, *columns):
    return sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr)


# 1. mixing


def levels(sizes, weights=(5, 2, 1), budget=1.5, cap=2.0):
    """Water-filling by repeated clamping."""
    names = sorted((n for n in sizes if n is not None)) + ([None] if None in sizes else [])
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    held, total = set(), budget * sum(sizes.values())
    while True:
        left = total - sum(cap * sizes[n] for n in held)
        open_ = [n for n in names if n not in held]
        w = sum(weight[n] for n in open_)
        over = [n for n in open_ if left * weight[n] / w >= cap * sizes[n]]
        if not over:
            return {n: cap * sizes[n] if n in held else left * weight[n] / w for n in names}
        held |= set(over)
        if len(held) == len(names):
            return {n: cap * sizes[n] for n in names}


def test_mixing(corpus, spark):
    rows, docs = corpus
    got = mixing.mix_plan(docs).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(spaced(r[1]))
    want = levels(sizes)
    source = defaultdict(list)
    for r in rows:
        source[r[0], len(spaced(r[1]))].append(r[3])
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
        options = source[r.doc_id, r["size"]]
        match = next(s for s in options if sizes[s] == r.source_size)
        assert math.isclose(r.target, want[match], abs_tol=1e-6)
        taken[match] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in sizes)
    assert as_rows(mixing.mix_plan(docs.repartition(2)), "doc_id", "size", "taken") == as_rows(mixing.mix_plan(docs), "doc_id", "size", "taken")


def test_mixed_rows(corpus):
    _, docs = corpus
    plan = {}
    for r in mixing.mix_plan(docs).where("doc_id IS NOT NULL AND doc_id <> 3").collect():
        plan[r.doc_id] = r
    words = defaultdict(int)
    mixed = mixing.mix(docs)
    assert mixed.columns == [*docs.columns, "repetition"]
    for r in mixed.where("doc_id IS NOT NULL AND doc_id <> 3").collect():
        words[r.doc_id] += len(spaced(r.text))
    assert {k: v.taken for k, v in plan.items() if v.taken} == dict(words)


def test_rows_without_ids_are_drawn_by_their_text(spark):
    rows = [(None, " ".join(["w"] * (1 + k % 7)) + f" {k}", f"s{k % 2}") for k in range(400)]
    plan = mixing.mix_plan(spark.createDataFrame(rows, "doc_id bigint, text string, source string"))
    sizes, taken = Counter(), Counter()
    for r in plan.collect():
        sizes[r.source_size, r.target] += r["size"]
        taken[r.source_size, r.target] += r.taken
    assert all(abs(taken[k] - k[1]) <= 0.5 and sizes[k] == k[0] for k in sizes) and len(sizes) == 2


def test_mixing_nothing(empty):
    assert mixing.mix_plan(empty).count() == 0 and mixing.mix(empty).count() == 0


# 6. language


def test_language_identification(spark):
    rng = random.Random(1)
    inventory = {"aa": "ka lo mi re tu ".split(), "bb": "sch ung der ei ".split(), "cc": ["ñe", "ción", "ar", "os"]}
    word = lambda lang: "".join(rng.choice(inventory[lang]) for _ in range(rng.randint(1, 4)))
    rows = [(i, " ".join(word(lang) for _ in range(rng.randint(2, 60))), lang) for i in range(300) for lang in [rng.choice(list(inventory))]]
    rows += [(1000, None, "aa"), (1001, "", "bb"), (1002, "12 !?", None), (None, "ka lo mi re tu ka", "aa"), rows[0]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("lang_pred", F.lit("clash"))
    got = language_id.identify_languages(docs).collect()
    truth = {i: lang for i, _, lang in rows}
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1 and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if r.doc_id in (1000, 1001, 1002):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred == truth[r.doc_id]
    kept = language_id.drop_unidentified(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 3


def test_code_lengths_are_exact():
    """The tables against prediction by partial matching written as a recursion."""
    texts = {"x": b"abab cab", "y": b"bbb ca"}
    order = 2
    grams = {}
    for lang, t in texts.items():
        padded = b"  " + t
        grams[lang] = Counter(padded[i - 2] << 16 | padded[i - 1] << 8 | padded[i] for i in range(2, len(padded)))
    import numpy as np

    model = language_id.fit({k: (np.array(sorted(g), dtype=np.int64), np.array([g[x] for x in sorted(g)])) for k, g in grams.items()}, order=order)

    def chance(lang, context, symbol):
        seen = Counter()
        for g, n in grams[lang].items():
            if (g >> 8) & ((1 << 8 * len(context)) - 1) == int.from_bytes(context, "big"):
                seen[g & 255] += n
        below = chance(lang, context[1:], symbol) if context else 1 / 256
        if not seen:
            return below
        total, distinct = sum(seen.values()), len(seen)
        return seen[symbol] / (total + distinct) if seen[symbol] else distinct / (total + distinct) * below

    probe = b"bab ac"
    padded = b"  " + probe
    symbols = np.frombuffer(probe, dtype=np.uint8)
    got = model.code_lengths(symbols, np.array([0, len(probe)]))[0]
    for k, lang in enumerate(model.languages):
        want = -sum(math.log2(chance(lang, padded[i - 2 : i], padded[i])) for i in range(2, len(padded)))
        assert math.isclose(got[k], want, rel_tol=1e-5)


def test_long_texts_are_summed_in_slices(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(7)
    letters = np.frombuffer(b"abcde ", dtype=np.uint8)
    grams = {lang: {int(x): 1 + int(x) % 5 for x in (letters[rng.integers(0, 6, 300)].astype(np.int64) << 16) | (letters[rng.integers(0, 6, 300)].astype(np.int64) << 8) | letters[rng.integers(0, 6, 300)]} for lang in ("x", "y", "z")}
    model = language_id.fit({k: (np.array(sorted(g), dtype=np.int64), np.array([g[x] for x in sorted(g)])) for k, g in grams.items()}, order=2)
    sizes = np.array([0, 3, 1, 0, 40, 2, 7, 0, 100, 1, 0])
    symbols, bounds = letters[rng.integers(0, 6, sizes.sum())], np.append(0, np.cumsum(sizes))
    whole = model.code_lengths(symbols, bounds)
    for size in (1, 2, 3, 10, 41):
        monkeypatch.setattr(language_id, "SLICE", size)
        assert np.allclose(model.code_lengths(symbols, bounds), whole)
    alone = np.array([model.code_lengths(symbols[a:b], np.array([0, b - a]))[0] for a, b in itertools.pairwise(bounds)])
    assert np.allclose(alone, whole)


def test_language_of_nothing(spark, empty):
    assert language_id.identify_languages(empty).count() == 0
    unlabelled = spark.createDataFrame([(1, "some text", None)], "doc_id bigint, text string, lang string")
    assert language_id.identify_languages(unlabelled).first().lang_pred == "und"


# 7. near duplicates


def components(rows, width, num, den):
    sets = []
    for r in rows:
        w = spaced(r[1], lower=True)
        sets.append(frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[find(i)].append(r[0])
    smallest = {k: min((x for x in v if x is not None), default=None) for k, v in least.items()}
    return sets, [smallest[find(i)] for i in range(len(rows))]


@pytest.mark.parametrize("width,threshold,num,den", [(3, "0.9", 9, 10), (5, "0.8", 4, 5)])
def test_near_duplicates(corpus, width, threshold, num, den):
    rows, docs = corpus
    sets, least = components(rows, width, num, den)
    want = sorted(((r[0], len(s), c) for r, s, c in zip(rows, sets, least, strict=True)), key=repr)
    assert as_rows(near_duplicates.near_duplicate_components(docs, width, threshold), "doc_id", "n_shingles", "component_id") == want


def test_near_duplicates_of_a_large_group(spark, monkeypatch):
    """Copies with many small changes, with few shingles allowed to be rare."""
    monkeypatch.setattr(near_duplicates, "FREQUENT", 4)
    rng = random.Random(8)
    base = ["w%d" % i for i in range(120)]
    rows = []
    for i in range(150):
        own = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4])):
            own[rng.randrange(len(own))] = "n%d" % rng.randrange(10_000)
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    _, least = components(rows, 3, 9, 10)
    assert as_rows(near_duplicates.near_duplicate_components(docs, 3, "0.9"), "doc_id", "component_id") == sorted(((r[0], c) for r, c in zip(rows, least, strict=True)), key=repr)


def test_near_duplicates_of_long_texts(spark, monkeypatch):
    """Sets of all size classes whose shingles are all frequent, compared in small blocks."""
    monkeypatch.setattr(near_duplicates, "FREQUENT", 1)
    monkeypatch.setattr(near_duplicates, "BLOCK_ROWS", 8)
    rng = random.Random(18)
    rows = []
    for length in (300, 420, 900, 2000):
        base = ["v%d" % rng.randrange(10**6) for _ in range(length)]
        for _ in range(14):
            own = list(base)
            for _ in range(rng.randrange(length // 20)):
                own[rng.randrange(length)] = "n%d" % rng.randrange(10**6)
            own = own[: rng.choice([length, length, length * 19 // 20])]
            rows += [(len(rows) + k, " ".join(own)) for k in range(2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for width, threshold, num, den in ((3, "0.9", 9, 10), (5, "0.8", 4, 5)):
        _, least = components(rows, width, num, den)
        assert 4 < len(set(least)) < 56
        assert as_rows(near_duplicates.near_duplicate_components(docs, width, threshold), "doc_id", "component_id") == sorted(((r[0], c) for r, c in zip(rows, least, strict=True)), key=repr)


def test_sets_whose_keys_clash(corpus):
    rows, docs = corpus
    _, least = components(rows, 3, 9, 10)
    found = near_duplicates.labelled_rows(docs, 3, "0.9", key_bits=4)
    groups = defaultdict(set)
    for r in found.where("component IS NOT NULL AND doc_id IS NOT NULL").collect():
        groups[r.component].add(r.doc_id)
    want = defaultdict(set)
    for r, c in zip(rows, least, strict=True):
        if spaced(r[1]) and r[0] is not None:
            want[c].add(r[0])
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def tasks_of(spark, group, run):
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = run()
    finally:
        spark.sparkContext._jsc.sc().clearJobGroup()
    tracker = spark.sparkContext.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    return out, sum(info.numTasks for info in map(tracker.getStageInfo, stages) if info)


@pytest.mark.parametrize("part_links", [0, 7, 64])
def test_components_of_links(spark, part_links):
    """Chains, stars and a ring in parts of several sizes, against a plain walk."""
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(100, 160)] + [(500 + i, 500) for i in range(1, 40)] + [(i, 900 + (i - 899) % 20) for i in range(900, 920)]
    links += [(rng.randrange(2000, 2200), rng.randrange(2000, 2200)) for _ in range(90)] + [(-9, 7), (7, 7), (3, 3), (-9, 7), (2**62, -(2**62))]
    rng.shuffle(links)
    least = {x: x for a, b in links if a != b for x in (a, b)}
    for _ in least:
        for a, b in links:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    frame = spark.createDataFrame(links, "a long, b long").repartition(3)
    assert as_rows(connected_components(frame, part_links=part_links), "node", "component") == sorted(least.items(), key=repr)
    assert connected_components(frame.where("a = b"), part_links=part_links).count() == 0


def test_components_take_tasks_by_their_links(spark):
    """A few links don't become a task and a file for every shuffle partition."""
    links = spark.createDataFrame([(i, i + 1) for i in range(50)], "a long, b long").coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        _, tasks = tasks_of(spark, "components", lambda: connected_components(links))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert 0 < tasks < 20


def test_words_that_a_polynomial_confuses(spark):
    """Two words of 1,024 letters that hash alike by any polynomial modulo 2**64."""
    one = "".join("ab"[bin(i).count("1") & 1] for i in range(1024))
    two = one.translate(str.maketrans("ab", "ba"))
    rest = " ".join("w%d" % i for i in range(19))
    docs = spark.createDataFrame([(1, f"{one} {rest}"), (2, f"{two} {rest}"), (3, f"{two} {rest}")], "doc_id bigint, text string")
    assert as_rows(substring_dedup.substring_dedup(docs), "doc_id", "n_removed") == [(1, 0), (2, 0), (3, 20)]
    assert as_rows(near_duplicates.near_duplicate_components(docs, 20, "0.9"), "doc_id", "component_id") == [(1, 1), (2, 2), (3, 2)]
    bench = spark.createDataFrame([(7, f"{one} w0 w1")], "item_id bigint, text string")
    assert as_rows(decontaminate.decontaminate(docs, bench), "doc_id", "n_hit") == [(1, 3), (2, 0), (3, 0)]


def test_one_of_each_group_stays(corpus, empty):
    rows, docs = corpus
    sets, least = components(rows, 5, 4, 5)
    kept = near_duplicates.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    want = Counter(r[0] for r, s in zip(rows, sets, strict=True) if not s)
    want.update({c for c, s in zip(least, sets, strict=True) if s})
    assert Counter(r.doc_id for r in kept.collect()) == want
    assert near_duplicates.drop_near_duplicates(empty).count() == 0 and near_duplicates.near_duplicate_components(empty).count() == 0
    with pytest.raises(ValueError):
        near_duplicates.near_duplicate_components(docs, 3, "0.4")


# 8. substrings


def cut(rows, window):
    places, gone = defaultdict(list), defaultdict(set)
    for d in {(r[0] is None, r[0] or 0, r[1] or "") for r in rows}:
        w = spaced(d[2])
        for i in range(len(w) - window + 1):
            places[tuple(w[i : i + window])].append((d[:2], i, d))
    for found in places.values():
        first = min(f[:2] for f in found)
        for at, i, d in found:
            if (at, i) != first:
                gone[d].update(range(i, i + window))
    out = []
    for r in rows:
        d, w = (r[0] is None, r[0] or 0, r[1] or ""), spaced(r[1])
        kept = [x for i, x in enumerate(w) if i not in gone[d]]
        out.append((r[0], len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window", [20, 6])
def test_substring_dedup(corpus, window):
    rows, docs = corpus
    assert as_rows(substring_dedup.substring_dedup(docs, window), "doc_id", "n_words", "n_removed", "kept_sha256") == cut(rows, window)


def test_substring_stage(corpus, empty):
    rows, docs = corpus
    made = substring_dedup.cut_repeats(docs)
    assert made.columns == docs.columns and substring_dedup.cut_repeats(empty).count() == 0 and substring_dedup.substring_dedup(empty).count() == 0
    want = {(r[0], r[3]) for r in cut(rows, 20) if r[2] < r[1]}
    for r in made.where("doc_id IS NOT NULL").collect():
        digest = hashlib.sha256(b" ".join(spaced(r.text))).hexdigest()
        if spaced(r.text):
            assert (r.doc_id, digest) in want


# 10. decontamination


def test_decontamination(corpus, spark, empty):
    rows, docs = corpus
    long = next(r[1] for r in rows if r[0] == 4)
    items = [(1, " ".join(long.split()[:20])), (2, "two, WORDS"), (3, None), (4, "!!"), (5, rows[10][1]), (6, rows[10][1]), (7, "one"), (8, " ".join("z%d" % i for i in range(30)))]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = []
    windows = {}
    for i, t in items:
        w = alnum(t)
        n = min(13, len(w))
        windows[i] = {tuple(w[s : s + n]) for s in range(len(w) - n + 1)} if w else set()
    for r in rows:
        w, hit, named = alnum(r[1]), set(), set()
        for i, own in windows.items():
            for g in own:
                for s in range(len(w) - len(g) + 1):
                    if tuple(w[s : s + len(g)]) == g:
                        hit.update(range(s, s + len(g)))
                        named.add(str(i))
        want.append((r[0], len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    got = decontaminate.decontaminate(docs, bench)
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert as_rows(got, *columns) == sorted(want, key=repr)
    assert any(r[5] for r in want)
    kept = decontaminate.drop_contaminated(docs, bench)
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r[0] for r in want if not r[5]) and kept.columns == docs.columns
    assert decontaminate.decontaminate(empty, bench).count() == 0
    nothing = decontaminate.decontaminate(docs, bench.limit(0))
    assert nothing.where("contaminated").count() == 0 and nothing.count() == len(rows)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "aa x bb"), (2, "aa bb"), (3, "bb aa")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "aa bb")], "item_id bigint, text string")
    windows = decontaminate.item_windows(items, "item_id", 13)
    terms = windows.select(F.explode("terms").alias("term")).distinct()
    bits = spark.sparkContext.broadcast(decontaminate.term_filter(terms))
    anchors = decontaminate.rarest_places(windows, decontaminate.term_counts(docs, terms, bits))
    index = decontaminate.positional_index(docs, bits, 12)
    found = lambda slop: sorted({r.doc_id for r in decontaminate.search(index, anchors, 1, 12, slop).collect()})
    assert found(0) == [2] and found(1) == [1, 2]


# 7. the wanted text of a node, whatever the filter lets through


def test_described_nodes_with_a_filter_that_passes_everything(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(near_duplicates, "member_masks", lambda keys: keys.sparkSession.sparkContext.broadcast(np.full(1 << 19, 0xFFFFFFFF, dtype=np.uint32)))
    texts = ["a b c d e f", "A b c d e f", "a  b c d e f", "a b c d e f"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    rows = near_duplicates.describe_and_count(docs, 5).where("block IS NULL").select("node", "text_key").distinct().collect()
    assert len(rows) == 3 and len({r.node for r in rows}) == 1
    for r in rows:
        wanted = spark.createDataFrame([(r.node, r.text_key)], "node bigint, text_key bigint")
        for whole in (False, True):
            assert [x.node for x in near_duplicates.described_nodes(docs, 5, wanted, whole).collect()] == [r.node]


# 5. language model


def test_language_model_counts(corpus, spark):
    rows, docs = corpus
    got = recurrent_lm.score_corpus(docs, share=0.9, seed_docs_share=0.5)
    tokens = [spaced(r[1], lower=True) + [None] for r in rows]
    out = [r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 2 for r in rows]
    c = Counter(t for own, o in zip(tokens, out, strict=True) if not o for t in own)
    n, v = sum(c.values()), len(c)
    want = sorted(((r[0], o, len(own), sum(t in c for t in own), n, round(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in own), 6)) for r, o, own in zip(rows, out, tokens, strict=True)), key=repr)
    found = got.withColumn("base", F.round("base_score", 6)).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base) for r in found), key=repr) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in found)


def test_language_model_without_documents(empty, spark):
    assert recurrent_lm.score_corpus(empty).count() == 0
    held = spark.createDataFrame([(i, "a b c") for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2], "doc_id bigint, text string")
    r = recurrent_lm.score_corpus(held).first()
    assert (r.train_tokens, r.n_known, r.n_tokens) == (0, 0, 4)
    assert math.isclose(r.base_score, 0.0, abs_tol=1e-9)


def test_language_model_learns_from_every_training_document(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"a b {i}") for i in range(300)], "doc_id bigint, text string")
    given = []

    def train(texts, lexicon, start, parts):
        given.append((texts.count(), parts))
        return start

    monkeypatch.setattr(recurrent_lm, "train", train)
    monkeypatch.setattr(recurrent_lm, "SEED_DOCS", 20, raising=False)
    recurrent_lm.score_corpus(docs, seed_docs_share=1.0)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert given[-1] == (sum(zlib.crc32(str(i).encode()) % 7 != 2 for i in range(300)), parts)
    assert 0 < given[0][0] < 60  # the one task's share doesn't grow with the corpus


def test_scores_do_not_change_with_the_partitions(corpus, spark, monkeypatch):
    monkeypatch.setattr(recurrent_lm, "TRAINER_WORDS", 1000)
    _, docs = corpus
    scores = lambda frame: as_rows(recurrent_lm.score_corpus(frame).withColumn("s", F.round("score", 3)), "doc_id", "n_tokens", "s")
    first = scores(docs)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert scores(docs.repartition(3)) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_chunks_are_those_of_the_documents():
    import numpy as np

    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 40, 60)
    sizes[30] = 500
    ids, first = np.arange(sizes.sum(), dtype=np.int32), np.append(0, np.cumsum(sizes))
    for cuts in ([0, 60], [0, 1, 2, 30, 31, 60], list(range(61))):
        given = [(ids[first[a] : first[b]], first[a : b + 1] - first[a]) for a, b in itertools.pairwise(cuts)]
        made = list(recurrent_lm._in_chunks(iter(given), 100))
        assert np.array_equal(np.concatenate([x for x, _ in made]), ids)
        assert np.array_equal(np.concatenate([np.diff(f) for _, f in made]), sizes)
        assert all(f[-1] == len(x) >= 100 > f[-2] for x, f in made[:-1])


def test_trainer_learns_from_every_word():
    import numpy as np

    for n in (0, 1, 2, 545, 1000, 70001):
        trainer = recurrent_lm.Trainer(recurrent_lm.Parameters.fresh(recurrent_lm.CLASS_SIZE, hidden=4))
        trainer.learn(np.arange(n, dtype=np.int32) % recurrent_lm.CLASS_SIZE, np.arange(0, n, 9))
        assert trainer.seen == n


def test_recurrent_model_is_a_distribution_and_learns():
    import numpy as np

    rng = np.random.default_rng(0)
    words = 2 * recurrent_lm.CLASS_SIZE
    p = recurrent_lm.Parameters.fresh(words, hidden=8)
    h = rng.normal(size=(1, 8)).astype(np.float32)
    every = recurrent_lm.log_probabilities(p.values, np.repeat(h, words, axis=0), np.arange(words))
    assert math.isclose(np.exp(every).sum(), 1.0, rel_tol=1e-4)
    # a text of alternating words is learned, and scoring by window equals one pass
    ids = np.tile(np.array([3, 70], dtype=np.int32), 4000)
    trainer = recurrent_lm.Trainer(p, rate=0.2)
    trainer.learn(ids, np.array([0]))
    first = np.array([0, 300, 301, 700])
    scores = recurrent_lm.score_documents(trainer.p, ids[:700], first)
    h = np.zeros((1, 8), dtype=np.float32)
    total = 0.0
    for w in ids[:300]:
        total += recurrent_lm.log_probabilities(trainer.p, h, np.array([w]))[0]
        h = recurrent_lm._step(trainer.p, h, trainer.p["X"][[w]])[0]
    assert math.isclose(scores[0], total, rel_tol=1e-3) and scores[0] / 300 > -0.5


def test_gradient():
    """Backpropagation against differences of the loss."""
    import numpy as np

    words = recurrent_lm.CLASS_SIZE * 2
    start = recurrent_lm.Parameters.fresh(words, hidden=4, seed=1)
    start.values = {k: v.astype(np.float64) for k, v in start.values.items()}
    ids = np.array([[1, 70], [65, 2], [3, 3]])
    opens = np.array([[True, True], [False, False], [False, True]])
    moved = {}
    trainer = recurrent_lm.Trainer(start)
    trainer._move = lambda name, grad, rows: moved.setdefault(name, np.zeros_like(trainer.p[name])).__setitem__(rows, grad)
    trainer.window(np.zeros((2, 4)), None, ids, opens)

    def loss(p):
        total = 0.0
        for s in range(2):
            h = np.zeros((1, 4))
            for t in range(3):
                h = np.zeros((1, 4)) if opens[t, s] else recurrent_lm._step(p, h, p["X"][[ids[t - 1, s]]])[0]
                total -= recurrent_lm.log_probabilities(p, h, ids[t, s][None])[0]
        return total / 2

    for name, at in (("U", (1, 2)), ("U", (3, 11)), ("C", (0, 1)), ("c", (1,)), ("X", (1, 5)), ("X", (65, 9)), ("V", (3, 2)), ("v", (70,))):
        p = {k: v.copy() for k, v in start.values.items()}
        p[name][at] += 1e-5
        up = loss(p)
        p[name][at] -= 2e-5
        assert math.isclose((up - loss(p)) / 2e-5, moved[name][at], rel_tol=1e-4, abs_tol=1e-7), (name, at)


def test_shingles_of_few_bytes_are_held_at_once():
    import pyarrow as pa

    from fieldloom.llm import near_duplicates

    text = pa.array(["one two three four five six " * 400] * 300)
    seen = list(near_duplicates.pieces(text))
    assert sum(c.n for c in seen) == 300 and max(len(c.data) for c in seen) <= 1 << 19
