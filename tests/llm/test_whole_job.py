"""Results that must be whole: against plain Python, on the small inputs where short cuts lose most."""

import random
import time

import numpy as np
import pytest
import xxhash

from tidelake.llm import html_extract, simhash


# --- near copies ---------------------------------------------------------------------


def shingles(text, size=5):
    ws = text.split()
    return [" ".join(ws[k : k + size]) for k in range(max(len(ws) - size + 1, 1))] if ws else []


def fingerprint(text):
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles(text)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(values, least):
    """The smallest index each text is linked to, by comparing all pairs."""
    sets, fps, root = [set(shingles(v)) for v in values], [fingerprint(v) for v in values], list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for b in range(len(values)):
        for a in range(b):
            union = sets[a] | sets[b]
            if bin(fps[a] ^ fps[b]).count("1") <= 2 or union and len(sets[a] & sets[b]) / len(union) >= least:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [find(k) for k in range(len(values))]


def short_copies(seed):
    """Short texts, copies with a word changed near an end (similarity down to 0.7), and a passage that many share."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    passage = [word() for _ in range(18)]
    out = []
    for k in range(60):
        base = [word() for _ in range(rng.choice([9, 16, 24, 31, 60]))] + passage * (k % 3 == 0)
        out.append(" ".join(base))
        for _ in range(2):
            copy = list(base)
            copy[rng.choice([0, 1, 2, 3, -1, -2, -3, -4])] = word()
            out.append(" ".join(copy))
    out += ["", "one", "one", "two words", "now just five words here", "now just five words there"]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("crowd", [2_000, 3])
def test_near_copies_of_short_texts_are_all_found(spark, monkeypatch, crowd):
    if crowd != 2_000:
        monkeypatch.setattr(simhash.rest, "__defaults__", (crowd,))
    values = short_copies(5)
    docs = spark.createDataFrame(list(enumerate(values)), "doc_id long, text string").repartition(3)
    found = {r["doc_id"]: r["root"] for r in simhash.near_copies(docs).collect()}
    assert [found.get(k, k) for k in range(len(values))] == groups(values, 0.8)


def long_copies(seed):
    """Texts of 100 to 900 words with common phrases, and copies with words changed in several places (similarity 0.6 to 0.95)."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    phrases = [[word() for _ in range(12)] for _ in range(4)]
    out = []
    for k in range(60):
        base = [w for _ in range(rng.randint(8, 70)) for w in (rng.choice(phrases) if rng.random() < 0.3 * (k % 3) else [word() for _ in range(12)])]
        out.append(" ".join(base))
        for _ in range(3):
            copy = list(base)
            for _ in range(max(1, int(len(base) * rng.uniform(0.005, 0.05)))):
                copy[rng.randrange(len(copy))] = word()
            out.append(" ".join(copy))
    rng.shuffle(out)
    return out


def test_near_copies_of_long_texts_are_all_found(spark):
    values = long_copies(8)
    want = groups(values, 0.8)
    assert 60 < len(set(want)) < len(values) - 60  # hundreds of pairs on either side of the threshold
    docs = spark.createDataFrame(list(enumerate(values)), "doc_id long, text string").repartition(3)
    found = {r["doc_id"]: r["root"] for r in simhash.near_copies(docs).collect()}
    assert [found.get(k, k) for k in range(len(values))] == want


def test_common_shingles_are_counted_over_all_texts(spark):
    from pyspark.sql import functions as F

    docs = spark.range(30_000).select(F.concat(F.lit("all texts begin so "), F.col("id").cast("string")).alias("text"))
    hashes, counts = simhash.common_shingles(docs, 4)
    assert counts.tolist() == [30_000] and len(hashes) == 1


def test_counting_common_shingles_shuffles_arrays_and_no_shingles(spark, monkeypatch):
    """2,000 texts of 60 words: 112,000 shingles, of which one is in all texts; a task hands its counts on in parts."""
    from pyspark.sql import functions as F

    frame, shuffled = type(spark.range(0)), []
    plain = frame.toArrow
    monkeypatch.setattr(frame, "toArrow", lambda df: shuffled.append(df._jdf.queryExecution().optimizedPlan().toString()) or plain(df))
    monkeypatch.setattr(simhash, "MOST_TEXTS", 700)
    words = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(60)), lambda k: F.concat(F.col("id"), F.lit("x"), k)))
    docs = spark.range(2_000).select(F.concat(F.lit("all texts begin like this "), words).alias("text")).repartition(3)
    cells, counts = simhash.common_shingles(docs, 5)
    assert counts[counts > 3].tolist() == [2_000] and len(cells) < 20
    assert "Aggregate" not in shuffled[0] and "RepartitionByExpression [part" in shuffled[0]


def test_near_dedup_hands_its_counts_on_in_small_batches(spark, monkeypatch):
    """Counts of 8 million cells are 16 MB: none is handed on as one batch, and no count is lost."""
    import pyarrow as pa

    frame, run = type(spark.range(0)), []
    plain = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda df, f, schema, **kw: run.append(f) or plain(df, f, schema, **kw))
    text = [" ".join(f"{k}x{j}" for j in range(60)) for k in range(1_200)]
    simhash.common_shingles(spark.createDataFrame([(t,) for t in text[:3]], "text string"), 5)
    batches = list(run[0](iter([pa.record_batch({"text": text})])))
    assert max(b.nbytes for b in batches) < 2 << 20
    assert sum(int(np.frombuffer(c.as_buffer(), np.uint16).sum()) for b in batches for c in b.column(1)) == 1_200 * 56


def test_sketches_are_prefixes_long_enough():
    n, common = np.array([0, 1, 5, 50, 5_000, 5_000, 5_000]), np.array([0, 0, 0, 0, 0, 3_000, 4_900])
    sizes = simhash.sketch_sizes(n, common, 0.8)
    assert sizes.tolist()[:4] == [0, 1, 2, 11] and 30 <= sizes[4] <= 40 < sizes[5] < 1_001 == sizes[6]


# --- HTML extraction -----------------------------------------------------------------

SENTENCES = [f"Paragraph {k} of the story goes on for a while, with commas, and then it ends." for k in range(6)]
STORY = "".join(f"<p>{x}</p>" for x in SENTENCES)


@pytest.mark.parametrize("wrap", ["<form id=aspnetForm>{}</form>", "<div class='layout--sidebar'>{}</div>", "<div id='social-history'>{}</div>", "<form><section class='legal-guide'>{}</section></form>"])
def test_wrapper_of_the_whole_page_is_opened(wrap):
    beside = "<div class='comments'><p>I liked this, a lot.</p></div><nav><a href=/>Home</a></nav>"
    page = "<html><body>" + wrap.format(beside + "<div>" + STORY + "</div>") + "</body></html>"
    assert html_extract.main_text(page)[0] == "\n".join(SENTENCES)


def test_parts_beside_the_article_stay_closed():
    page = "<body><div>" + STORY + "</div><div class='comments'>" + STORY * 3 + "</div><form>" + STORY + "</form></body>"
    assert html_extract.main_text(page)[0] == "\n".join(SENTENCES)
    assert html_extract.main_text("<body><div style='display:none' class='form'>" + STORY + "</div></body>")[0] == ""
    assert html_extract.main_text("<body><div class='menu'><a>Home</a> <a>News</a></div></body>")[0] == ""


MENU = "<div><a href=/>Home</a> <a href=/n>News</a> <a href=/a>About us</a></div>"
PLAIN = "<body><table><tr><td>" + MENU + "</td></tr></table><div><h2>A head</h2><p>The lead, which is long enough to count.</p><div>" + STORY + "<ul><li>one</li><li>two</li></ul><p>Short.</p>" + STORY + "</div></div>" + MENU + "<div>All rights with us</div></body>"


def test_paths_over_the_threshold_are_chosen(monkeypatch):
    """No tag, class or id says what is the article; without the ratios the menus come along."""
    want = "\n".join(["A head", "The lead, which is long enough to count.", *SENTENCES, "one", "two", "Short.", *SENTENCES])
    assert html_extract.main_text(PLAIN)[0] == want
    monkeypatch.setattr(html_extract, "path_scores", lambda page, nodes, ratios=None: np.ones(len(nodes)))
    assert html_extract.main_text(PLAIN)[0] != want


def random_page(rng):
    def part(depth):
        kind = rng.choice(["div", "p", "ul", "section", "span", "b", "text", "text", "text"]) if depth < 6 else "text"
        if kind == "text":
            return " ".join(rng.choice(["word", "more,", "end.", "x"]) for _ in range(rng.randint(0, 12)))
        return f"<{kind}>" + "".join(part(depth + 1) for _ in range(rng.randint(0, 4))) + f"</{kind}>"

    return "".join(part(0) for _ in range(6))


def test_path_scores_are_those_of_plain_python():
    rng = random.Random(7)
    for _ in range(60):
        page = html_extract.parse(random_page(rng))
        paths = []
        for e in page.element:
            path = []
            while e:
                path.insert(0, page.tag[e])
                e = page.parent[e]
            paths.append(path)
        texts = [" ".join(t.split()) for t in page.text]
        same = [[j for j in range(len(paths)) if paths[j] == p] for p in paths]
        filled = [max(sum(bool(texts[j]) for j in g), 1) for g in same]
        mean = [sum(len(texts[j]) for j in g) / n for g, n in zip(same, filled)]
        spread = [max(sum(len(texts[j]) ** 2 for j in g) / n - m * m, 0) ** 0.5 for g, n, m in zip(same, filled, mean)]
        pointed = [sum(texts[j].count(",") + texts[j].count(".") for j in g) / n for g, n in zip(same, filled)]

        def like(a, b):
            shared = 0
            while shared < min(len(a), len(b)) and a[shared] == b[shared]:
                shared += 1
            return 1 if a == b else shared / max(len(a), len(b), 1)

        def smooth(values):
            out = []
            for k in range(len(values)):
                around = [(k, 1.0)] + [(k + s, w * like(paths[k], paths[k + s])) for s, w in ((-2, 0.15), (-1, 0.6), (1, 0.6), (2, 0.15)) if 0 <= k + s < len(values)]
                out.append(sum(w * values[j] for j, w in around) / sum(w for _, w in around))
            return out

        want = [a * (1 + b) for a, b in zip(smooth([m + s for m, s in zip(mean, spread)]), smooth(pointed))]
        assert html_extract.path_scores(page, np.arange(len(paths))).tolist() == pytest.approx(want)


@pytest.mark.parametrize("page", ["<div>text here, now. " * 10_000, "<div class=ad>text, now. " * 10_000, "<form>x, y. " * 10_000, "<b>x " * 10_000 + "<p>y" * 10_000, "<!-- " + "x" * 1_000_000, "<p>" + "long, text. " * 200_000])
def test_deep_and_long_pages_take_linear_time(page):
    began = time.perf_counter()
    html_extract.main_text(page)
    assert time.perf_counter() - began < 5


def test_empty_and_repeated_pages(spark):
    empty = spark.createDataFrame([], "page_id long, html string")
    assert html_extract.extract(empty).count() == 0
    row = (1, "<article><p>Words, here.</p></article>")
    out = html_extract.extract(spark.createDataFrame([row, row], "page_id long, html string")).collect()
    assert [r["main"]["text"] for r in out] == ["Words, here."] * 2


# --- scores inside articles ----------------------------------------------------------


def _article(rng, adverts):
    """An article whose divisions without a class hold short calls between its paragraphs; its wanted lines."""
    words = "stone river light old window garden winter letter bread silver".split()
    sentence = lambda n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + rng.choice((", ", " and ")) + " ".join(rng.choice(words) for _ in range(n)) + "."
    wanted, body = ["A title"], ["<h1>A title</h1>"]
    for k in range(rng.randint(4, 9)):
        line = " ".join(sentence(rng.randint(5, 12)) for _ in range(rng.randint(2, 4))) if k % 4 else sentence(3)
        wanted.append(line)
        body.append(f"<p>{line}</p>")
        if adverts and rng.random() < 0.5:
            body.append(f"<div><b>{rng.choice(('Buy now', 'Open an account', 'Our offer'))}</b></div>")
    return f"<html><body><nav><a href=/>Home</a></nav><article>{''.join(body)}</article><footer>end</footer></body></html>", "\n".join(wanted)


def test_scores_drop_unmarked_adverts_inside_an_article(monkeypatch):
    rng = random.Random(2)
    pages = [_article(rng, True) for _ in range(60)]
    assert [html_extract.main_text(page)[0] for page, _ in pages] == [text for _, text in pages]
    clean = [_article(rng, False) for _ in range(30)]
    assert [html_extract.main_text(page)[0] for page, _ in clean] == [text for _, text in clean]
    monkeypatch.setattr(html_extract, "path_scores", lambda page, nodes, ratios=None: np.ones(len(nodes)))
    assert sum(html_extract.main_text(page)[0] != text for page, text in pages) > 40


def test_divisions_of_text_stay_in_an_article():
    """Paragraphs as divisions, short ones too: their path is that of content."""
    lines = ["A long line of text, with marks, that says a good deal about nothing in particular.", "Short one.", "Another long line of text, with marks, that says a good deal about nothing at all."]
    page = "<article>" + "".join(f"<div>{x}</div>" for x in lines) + "</article>"
    assert html_extract.main_text(page)[0] == "\n".join(lines)


def test_hashes_of_long_slices_leave_no_tables_behind():
    """A worker keeps 8 MB of powers at most, and hashes are those of short slices."""
    from tidelake.llm import words as W

    data = np.frombuffer(b"some words of a text " * 100_000, np.uint8)
    starts, ends = np.array([0, 5, 1_000_000]), np.array([4, 10, 1_000_300])
    long = W.span_hash(data, starts, ends)
    assert sum(p.nbytes for p in W._powers) <= 8 << 20
    assert [int(W.span_hash(data[a:b], np.array([0]), np.array([b - a]))[0]) for a, b in zip(starts, ends)] == long.tolist()
    assert sum(p.nbytes for p in W._powers) <= 8 << 20
