"""Operators on pages, vectors and conversations."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.llm import chat_format, html_extract, nearest_neighbours, url_filter

# 2. pages

ARTICLE = "The first paragraph of the article is long enough to stand out from all that is around it, surely."
PAGES = [
    (f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><ul><li><a href=x>Home</a></ul></nav><div class='ad'>Buy!</div><article><h1>Head &amp; shoulders</h1><p><b>{ARTICLE}<br><p>Second\n  one&nbsp;here.</article><footer>&copy; us</footer></body></html>", f"Head & shoulders\n{ARTICLE}\nSecond one here."),
    (f"<body><div id=menu><a href=a>One</a> <a href=b>Two</a></div><div id=main><h2>H</h2><p>{ARTICLE}</p><p>Es.</p></div><form>Name <input></form><section class='comments'><p>{ARTICLE} I agree!</p></section><aside>Also {ARTICLE}</aside>", f"H\n{ARTICLE}\nEs."),
    (f"<article><header><h1>In the head</h1></header><p>{ARTICLE}</p><div class='social-share'>Share</div><p>After &lt;it&gt;</p></article>", f"In the head\n{ARTICLE}\nAfter <it>"),
    ("<script>var t='</p><p>no</p>';</script><!-- <p>no</p> --><article><p>a<b>b</b>c</p><table><tr><td>1<td>2</table></article>", "abc\n1\n2"),
    (f"<p>{ARTICLE}<script>never closed", ARTICLE),
    ("<article><p>Same</p><p>Same</p></article>", "Same\nSame"),
    ("<nav>only a menu</nav>", ""),
    ("", ""),
    (None, ""),
    ("plain words without any markup", "plain words without any markup"),
    ("<article><p title='a > b'>x</p><p hidden>no</p><p style='display: none'>no</p>y</article>", "x\ny"),
]


def test_main_text(spark):
    frame = spark.createDataFrame([(i, f"http://h/{i}", h, "clash") for i, (h, _) in enumerate(PAGES)] + [(None, None, "<p>z", "q")], "page_id bigint, url string, html string, text string")
    got = {r.page_id: r for r in html_extract.extract_main_text(frame).collect()}
    for i, (_, want) in enumerate(PAGES):
        assert (got[i].text, got[i].n_chars, got[i].url) == (want, len(want), f"http://h/{i}")
    assert got[None].text == "z" and html_extract.extract_main_text(frame.limit(0)).count() == 0


def test_short_and_linked_lines_of_an_unmarked_page_stay():
    share = "<div class='share'>Share</div>"
    linked = "See <a href=x>another long text about it</a>"
    page = f"<div><a href=a>Home</a></div><h1>Title</h1>{share * 3}<p>{ARTICLE}</p><p>{linked}</p>{share * 3}<p>Short end.</p><div><a href=b>Top</a></div>"
    assert html_extract.main_text(page) == f"Title\n{ARTICLE}\nSee another long text about it\nShort end."


def test_large_page():
    many = "".join(f"<p>paragraph {i} &amp; more</p>" for i in range(20000))
    assert html_extract.main_text(f"<nav>{many}</nav><article>{many}</article>").count("\n") == 19999


def plain_extent(counts, window, level):
    """Surge and dive with every sum written out, and stretches grown one by one."""
    n = len(counts)
    sums = [sum(counts[k] for k in range(i - window + 1, i + 1) if 0 <= k < n) for i in range(n + window - 1)]
    if not any(counts):
        return 0, 0
    level = level if max(sums) >= level else 1
    lines = set()
    for i, x in enumerate(sums):
        if x >= level:
            for step in (1, -1):
                j = i
                while 0 <= j < len(sums) and sums[j] > 0:
                    lines |= {k for k in range(j - window + 1, j + 1) if 0 <= k < n and counts[k]}
                    j += step
    return min(lines), max(lines) + 1


def test_surge_and_dive_against_all_sums():
    rng = np.random.default_rng(12)
    for _ in range(400):
        counts = np.where(rng.random(rng.integers(1, 30)) < rng.choice([0.2, 0.5, 0.9]), rng.integers(1, 60, 1), 0) * rng.integers(1, 4)
        for window, level in ((3, 80), (1, 20), (4, 100)):
            assert html_extract.surge_and_dive(counts, window, level) == plain_extent(counts.tolist(), window, level)


def test_windows_decide_what_no_tag_marks():
    links = "<div><a href=x>A link line</a></div>"
    page = f"<div>Far note</div>{links * 3}<h1>Title</h1><p>{ARTICLE}</p>{links * 2}<p>Near.</p>{links * 3}<div>Far end</div>"
    assert html_extract.main_text(page) == "\n".join(["Title", ARTICLE, "A link line", "A link line", "Near."])


def test_prose_in_the_way_of_hints():
    prose = " ".join(f"Sentence number {i} about it." for i in range(25))
    assert html_extract.main_text(f'<p>{ARTICLE}</p><div class="related-work"><h2>Related</h2><p>{prose}</p></div><p>End.</p>') == f"{ARTICLE}\nRelated\n{prose}\nEnd."
    assert html_extract.main_text(f'<p>{ARTICLE}</p><div class="related"><ul><li><a href=x>{ARTICLE}</a></ul></div><p>End.</p>') == f"{ARTICLE}\nEnd."
    five = [f"{ARTICLE} No. {i}" for i in range(5)]
    assert html_extract.main_text("<article><p>Teaser</article>" + "".join(f"<p>{x}</p>" for x in five)) == "\n".join(["Teaser", *five])
    assert html_extract.main_text("<main><p>x</p><div></div><p>y</p></main>") == "x\ny"
    assert html_extract.main_text(f"<article><p>Let <math><mi>x</mi></math> be <label>so</label>. {ARTICLE}</article>") == f"Let x be so. {ARTICLE}"


@pytest.mark.parametrize("piece", ["<a ", "<a '", '<a "', "<", "</", "<!--", "<![CDATA[", "<script>", "<a b='", "&", "<p a=\"'>", "<div class='related'>", "</div><p>"])
def test_broken_markup_takes_time_in_proportion(piece):
    import time

    began = time.process_time()
    html_extract.main_text(f"<p>{ARTICLE}</p>" + piece * (1_000_000 // len(piece)))
    assert time.process_time() - began < 20


def test_pages_against_their_making():
    """Pages written from known articles, with all kinds of other elements around and inside them."""
    rng = np.random.default_rng(31)
    text = lambda low, high: " ".join("w%d" % rng.integers(99) for _ in range(rng.integers(low, high)))
    other = ["<nav><ul><li><a href=x>{}</a><li><a href=y>m</a></ul></nav>", "<footer>{}</footer>", "<aside><p>{}</p></aside>", "<form><label>{}</label><input></form>", "<div class='ad'>{}</div>", "<div id='cookie-notice'><p>{}</p></div>", "<section class='comments'><p>{}</p></section>", "<script>var a = '<p>{}</p>';</script>", "<style>p{{}} {}</style>", "<!-- {} -->", "<div role='banner'>{}</div>"]
    noise = lambda: "".join(rng.choice(other).format(text(1, 60)) for _ in range(rng.integers(0, 4)))
    for k in range(150):
        blocks = [text(1, 50) for _ in range(rng.integers(1, 12))]
        tag = rng.choice(["article", "main", "div"])
        body = "".join((f"<h2>{b}</h2>" if rng.random() < 0.2 else f"<p>{b} &amp;\n <b>so</b>{'</p>' if rng.random() < 0.7 else ''}") + noise() for b in blocks)
        want = [b if f"<h2>{b}</h2>" in body else f"{b} & so" for b in blocks]
        assert html_extract.main_text(f"<html><head><title>{text(1, 9)}</title></head><body>{noise()}<{tag}>{body}</{tag}>{noise()}</body></html>") == "\n".join(want), k


# 3. urls

URLS = {
    "https://WWW.example.com/en/1": ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
    "https://a.example.com/en/1?q=//": ("a.example.com", "/en/1", "example.com/en/", "block"),
    "https://a.example.com/de/1#x": ("a.example.com", "/de/1", "com/", "allow"),
    "https://a.example.com": ("a.example.com", "", None, "allow"),
    "http://b.net/fr/": ("b.net", "/fr/", "net/fr/", "block"),
    "http://b.net/FR/": ("b.net", "/FR/", None, "allow"),
    "http://xnet/es/1": ("xnet", "/es/1", None, "allow"),
    "http://porn.org/": ("porn.org", "/", None, "block"),
    "http://popcornporno.org/": ("popcornporno.org", "/", None, "allow"),
    "http://cheap-pills.org/": ("cheap-pills.org", "/", None, "block"),
    "http://cheap.org/cheap": ("cheap.org", "/cheap", None, "allow"),
    "no scheme": ("", "", None, "allow"),
    "x://": ("", "", None, "allow"),
    "a://b://c/d": ("b:", "//c/d", None, "allow"),
}


def test_urls(spark):
    frame = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS)] + [(99, None, "x")], "page_id bigint, url string, verdict string")
    got = {r.page_id: r for r in url_filter.judge_urls(frame).collect()}
    for i, want in enumerate(URLS.values()):
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == want
    assert (got[99].host, got[99].verdict) == ("", "allow") and url_filter.judge_urls(frame.limit(0)).count() == 0


def test_url_weights_repeats_and_refusals(spark):
    terms = (("gold", "strict", 5), ("red", "soft", 2), ("blue", "soft", 3), ("grey", "soft", 1))
    urls = {"http://a.de/gold": "block", "http://red.de/red-red": "allow", "http://red.de/blue": "block", "http://red.de/grey": "allow", "http://red.de/grey/blue": "block", "http://blue.de/bluegold": "allow"}
    rows = [(i, u) for i, u in enumerate(urls)] * 3
    got = url_filter.judge_urls(spark.createDataFrame(rows, "page_id bigint, url string"), vocabulary=terms, limit=5).collect()
    assert sorted((r.page_id, r.verdict) for r in got) == sorted((i, v) for i, v in enumerate(urls.values()) for _ in range(3))
    assert url_filter.judge_urls(spark.createDataFrame(rows, "page_id bigint, url string"), vocabulary=()).where("verdict = 'block'").count() == 0
    for wrong in ((("a", "hard", 1),), (("a", "soft", 1), ("a", "strict", 2)), (("", "soft", 1),)):
        with pytest.raises(ValueError):
            url_filter.vocabulary_hits(wrong)


# 9. vectors


def exact(rows, every, k):
    out = {}
    for q, x in rows:
        if q % every == 0:
            near = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(x, y, strict=True))), v) for v, y in rows if v != q and len(y) == len(x))
            out[q] = near[:k]
    return out


def test_small_table_is_exact(spark):
    rng = np.random.default_rng(4)
    vectors = [(i, rng.normal(size=8).tolist()) for i in range(120)]
    vectors += [(200 + i, vectors[0][1]) for i in range(15)] + [(300, vectors[7][1])]
    bad = [(400, None), (401, [0.0] * 8), (402, [float("nan")] + [1.0] * 7), (403, [None] + [1.0] * 7), (404, []), (410, [float("inf")] * 8)]
    frame = spark.createDataFrame([(i, v, "clash") for i, v in [*vectors, *bad, vectors[5], (None, [1.0] * 8)]], "vec_id bigint, embedding array<double>, rank string")
    got = nearest_neighbours.nearest_neighbours(frame, every=10, k=5, degree=16).collect()
    want = exact(vectors, 10, 5)
    assert {r.query_id for r in got} == set(want)
    for q, group in itertools.groupby(sorted(got, key=lambda r: (r.query_id, r["rank"])), key=lambda r: r.query_id):
        group = list(group)
        assert [r["rank"] for r in group] == list(range(1, 6))
        assert [r.vec_id for r in group] == [v for _, v in want[q]]
        assert all(math.isclose(r.score, d, abs_tol=1e-9) for r, (d, _) in zip(group, want[q], strict=True))


def test_fewer_candidates_and_none(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 2.0]), (100, [1.0, 1.0, 1.0])], "vec_id bigint, embedding array<float>")
    got = [(r.query_id, r["rank"], r.vec_id) for r in nearest_neighbours.nearest_neighbours(frame, degree=8).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2)]
    assert nearest_neighbours.nearest_neighbours(frame.limit(0)).count() == 0


def test_graph_in_many_parts(spark):
    """Each part of the graph holds three nodes, and some lengths have few vectors: still k rows, or all."""
    points = {3 * c + j: [100.0 * c + 1, 0.125 * j, 1.0] for c in range(10) for j in range(3)} | {60: [1.0, 2.0], 61: [1.0, 4.0], 63: [5.0]}
    frame = spark.createDataFrame(list(points.items()), "vec_id long, embedding array<double>")
    got = nearest_neighbours.nearest_neighbours(frame, every=3, k=5, degree=2).collect()
    expected = []
    for q in (i for i in points if i % 3 == 0):
        near = sorted((math.dist(points[q], v), i) for i, v in points.items() if i != q and len(v) == len(points[q]))
        expected += [(q, rank, i, d) for rank, (d, i) in enumerate(near[:5], 1)]
    assert sorted(map(tuple, got)) == sorted(expected)


def test_recall(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 16))
    x = centres[rng.integers(0, 20, 2000)] + 0.4 * rng.normal(size=(2000, 16))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = nearest_neighbours.nearest_neighbours(frame, every=50, k=10, degree=20, beam=40).collect()
    found = {(r.query_id, r.vec_id) for r in got}
    hits = 0
    for q in range(0, 2000, 50):
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hits += sum((q, int(v)) in found for v in np.argsort(d)[:10])
    assert hits / 400 >= 0.9


# 4. conversations


def test_blocks_give_the_result_of_one_pass(spark, monkeypatch):
    rng = np.random.default_rng(2)
    seen = rng.integers(0, 28, 57)
    whole = chat_format.decode(seen)
    monkeypatch.setattr(chat_format, "BLOCK_LINES", 8)
    start, moves, scores = chat_format._logs()
    tables = [chat_format._through(seen[i : i + 8], moves, scores, start if i == 0 else None) for i in range(0, 57, 8)]
    best, back = tables[0][0], []
    for t in tables[1:]:
        ways = best[:, None] + t
        back.append(ways.argmax(axis=0))
        best = ways.max(axis=0)
    ends = [int(best.argmax())]
    for b in reversed(back):
        ends.append(int(b[ends[-1]]))
    ends.reverse()
    pieces = [chat_format.decode(seen[i : i + 8], None if i == 0 else ends[k - 1], ends[k]) for k, i in enumerate(range(0, 57, 8))]
    assert np.concatenate(pieces).tolist() == whole.tolist()


def score(path, seen):
    start, moves, scores = chat_format._logs()
    return start[path[0]] + scores[seen[0], path[0]] + sum(moves[a, b] + scores[s, b] for a, b, s in zip(path, path[1:], seen[1:], strict=False))


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(6)
    for _ in range(5):
        seen = rng.integers(0, 28, 4)
        best = max(itertools.product(range(6), repeat=4), key=lambda p: score(p, seen))
        assert math.isclose(score(chat_format.decode(seen).tolist(), seen), score(best, seen))


@pytest.mark.parametrize("block", [3, 1024])
def test_transcripts(spark, monkeypatch, block):
    monkeypatch.setattr(chat_format, "BLOCK_LINES", block)
    texts = {
        1: "System: Be brief.\nUser: Hello there\nhow are you?\n\nAssistant: Fine.\nA second line.\nuser: bye",
        2: "### Human:\nWhat is it?\n### Assistant:\nIt is this.",
        3: "> asked this?\nAnd the answer is plain text.\n> and that?\nYes.",
        4: "\n\n",
        5: "no speaker at all",
    }
    lines = [(c, i, x) for c, t in texts.items() for i, x in enumerate(t.split("\n"))] + [(None, 0, "User: who"), (None, 1, None)]
    frame = spark.createDataFrame(lines, "conv_id bigint, line_no bigint, line string").withColumn("role", F.lit("clash"))
    got = {}
    for r in chat_format.parse_transcripts(frame).orderBy("conv_id", "turn").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
        assert r.rendered == f"<|{r.role}|>\n{r.text}<|end|>\n"
    assert got[1] == [("system", "Be brief."), ("user", "Hello there\nhow are you?"), ("assistant", "Fine.\nA second line."), ("user", "bye")]
    assert got[2] == [("user", "What is it?"), ("assistant", "It is this.")]
    assert got[3] == [("user", "asked this?"), ("assistant", "And the answer is plain text."), ("user", "and that?"), ("assistant", "Yes.")]
    assert len(got[4]) == 1 and got[4][0][1] == "" and len(got[5]) == 1 and got[None] == [("user", "who")]
    assert chat_format.parse_transcripts(frame.limit(0)).count() == 0


def test_round_trip(spark):
    rows = [(c, t, ("user", "assistant")[t % 2], f"text {c} of turn {t}.") for c in range(40) for t in range(6)]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = chat_format.parse_transcripts(chat_format.as_transcript(frame))
    assert sorted(tuple(r) for r in got.select("conv_id", "turn", "role", "text").collect()) == sorted(rows)


def test_rows_of_one_turn_follow_each_other_whole(spark):
    rows = [(0, 0, "user", "hello\nthere"), (0, 0, "user", "hello\nthere"), (0, 1, "assistant", "yes"), (2, None, "user", "AA\nBB"), (2, 0, "user", "first\nsecond"), (2, 1, "assistant", "ok")]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    for style in (0, 2):  # of conversations 0 and 2, whatever they are: no line may stand between those of its row
        lines = [(r.conv_id, r.line) for r in chat_format.as_transcript(frame).orderBy("conv_id", "line_no").collect() if r.conv_id == style]
        text = "\n".join(x.replace("> ", "") for _, x in lines)
        assert text.count("hello\nthere") == (2 if style == 0 else 0)
        if style == 2:
            assert text.index("first\nsecond") < text.index("ok") < text.index("AA\nBB")


def test_model_is_counted_from_known_lines(spark):
    rows = [(c, t, ("user", "assistant")[t % 2], f"text {c} of turn {t}.\nmore\n\nend") for c in range(60) for t in range(4)] + [(None, None, None, None), (7, 9, "narrator", "")]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("state", F.lit("clash"))
    model = chat_format.fit(chat_format.labelled_lines(frame))
    starts, moves = np.zeros(6), np.zeros((6, 6))
    states = {}
    for r in sorted(chat_format.labelled_lines(frame).collect(), key=lambda r: (r.conv_id is None, r.conv_id or 0, tuple(x or 0 for x in r.line_no))):
        states.setdefault(r.conv_id, []).append(r.state)
    assert states[7][-1] % 3 == 1 and states[None][0] == 1
    for path in states.values():
        starts[path[0]] += 1
        for a, b in itertools.pairwise(path):
            moves[a, b] += 1
    able = np.array([[b < 3 or b % 3 == a % 3 for b in range(6)] for a in range(6)])
    assert np.allclose(np.exp(model.start), (starts + 1) / (starts + 1).sum())
    assert np.allclose(np.exp(model.moves), (moves + 1) * able / ((moves + 1) * able).sum(axis=1, keepdims=True))
    assert np.allclose(np.exp(model.scores).sum(axis=0), 1)
    assert chat_format.fit(chat_format.labelled_lines(frame.limit(0))).moves.shape == (6, 6)


def test_held_out_conversations_come_back(spark):
    truth = {}
    table = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    for r in table.orderBy("conv_id", "turn").collect():
        truth.setdefault(r.conv_id, []).append((r.role, r.text.strip(" \n\t\r")))
    got = {}
    for r in chat_format.format_conversations(table).where("held_out").orderBy("conv_id", "turn").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    right = sum(a == b for c in got for a, b in zip(got[c], truth[c], strict=False))
    total = sum(len(truth[c]) for c in got)
    assert len(got) > 10 and right >= 0.97 * total, (right, total)


def test_search_stores_one_table_a_round(spark, monkeypatch):
    calls = []
    kept = nearest_neighbours.checkpointed
    monkeypatch.setattr(nearest_neighbours, "checkpointed", lambda frame: calls.append(1) or kept(frame))
    nodes = spark.createDataFrame([(i, [float(i + 1)]) for i in range(6)], "node bigint, vector array<double>")
    graph = spark.createDataFrame([(i, i + 1, 1.0) for i in range(5)], "u bigint, v bigint, d double")
    starts = nodes.where("node = 0").select("node", "vector").withColumnRenamed("node", "q")
    met = nearest_neighbours.greedy_search(starts, graph, nodes, 96, 16)
    assert {(r.node, r.d) for r in met.collect()} == {(i, float(i)) for i in range(6)}
    assert len(calls) <= 2 + 6  # the graph, the start, and each node of the line in a round of its own
