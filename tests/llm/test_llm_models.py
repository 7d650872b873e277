"""Token counts against the library, the classifier on held-out rows, and HTML extraction on small sites."""

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from keydrift.llm import classifier, html_text, tables, token_counts

SF = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "Hello  World", "it's we'll İstanbul ΣΑΣ ﬁ é e ́", "<|endoftext|>x<|startoftext|> a<|endoftext|>b", "a\x1cb c d\x85e　f",
    "日本語 テキスト 123,456.78", "x" * 30000, "word " * 20000, "퟿𝒳🙂🙂 \t\r\n\x0b\x0c z",
]


def test_counts_are_the_library_s(spark, tmp_path):
    texts = ODD + [r["text"] for r in tables.table(spark, SF, "documents").select("text").collect()]
    rows = [(k, t, "x") for k, t in enumerate(texts)] + [(3, "Hello  World", "y"), (None, "Hello World", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string")
    library = Tokenizer.from_file(token_counts.vocabulary_path())
    want = sorted((i if i is not None else -1, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows)
    cache = str(tmp_path / "cache")
    first = token_counts.counted(docs.limit(50), cache).collect()
    stored = spark.read.parquet(cache).count()
    got = [(r[0] if r[0] is not None else -1, r[1], r[2]) for r in token_counts.counted(docs, cache).collect()]
    assert len(first) == 50 and sorted(got) == want
    # counts are appended once for each content, and nothing is encoded again
    cached = spark.read.parquet(cache)
    assert stored < cached.count() == cached.select("digest").distinct().count() == token_counts.keyed(docs).select("digest").distinct().count()
    token_counts.append_misses(docs, cache)
    assert spark.read.parquet(cache).count() == cached.count()
    assert token_counts.counted(docs.limit(0), str(tmp_path / "none")).count() == 0


def _labelled(spark, n=400):
    rnd = np.random.default_rng(3)
    words = ["the", "of", "river", "stone", "and", "green"]
    rows = []
    for k in range(n):
        good = bool(rnd.random() < 0.6)
        text = " ".join(rnd.choice(words, 40)) if good else " ".join(rnd.choice(words, 40)).upper().replace(" ", "!! ")
        rows.append((k, text, int(good)))
    docs = spark.createDataFrame([(k, t, "en") for k, t, _ in rows] + [(n, None, "en"), (n + 1, "", "de")], "doc_id long, text string, score string")
    return docs, spark.createDataFrame([(k, y, 0) for k, _, y in rows if k % 3], "doc_id long, quality int, toxic int")


def test_classifier_on_held_out_rows(spark):
    docs, labels = _labelled(spark)
    held_out = tables.crc(F.col("doc_id")) % 5 == 0
    w, b = classifier.train(docs, labels, ~held_out)
    rows = classifier.scored(docs, w, b).join(labels, "doc_id", "left").withColumn("held", held_out).collect()
    assert len(rows) == 402 and all(0 <= r["score"] <= 1 for r in rows)
    judged = [r for r in rows if r["held"] and r["quality"] is not None]
    assert len(judged) > 30 and all((r["score"] >= classifier.CUT) == bool(r["quality"]) for r in judged)
    again = classifier.train(docs, labels, ~held_out)
    assert np.array_equal(w, again[0]) and b == again[1]


def test_classifier_without_labels(spark):
    docs, labels = _labelled(spark, 30)
    for some in (labels.limit(0), labels.where("quality = 1")):
        w, b = classifier.train(docs, some, F.lit(True))
        assert {r["score"] for r in classifier.scored(docs, w, b).collect()} == {0.5}
    assert classifier.scored(docs.limit(0), w, b).count() == 0


def test_dual_descent_separates():
    rows = [np.array([k % 2, 2 + k % 5]) for k in range(40)]
    y = np.array([1 if k % 2 else -1 for k in range(40)])
    w = classifier.dual_descent(rows, y, np.ones(1 << classifier.BITS))
    assert all(np.sign(w[r].sum() / np.sqrt(2) + w[-1]) == t for r, t in zip(rows, y, strict=True))


def test_page_reading():
    def text(html):
        return html_text.Page(html).text(set())

    assert text("<article><h1>Hi &amp; you&am</h1><p>a<b>b</b> c<p>d\n e<ul><li>x<li>y</ul></article>") == "Hi & you&am\nab c\nd e\nx\ny"
    assert text("<nav>n</nav><header>h</header><div class='ad'>a</div><p>kept</p><footer>f</footer><aside>s</aside>") == "kept"
    assert text("<script>if (a<b) {'</p>'}</script><style>p{}</style><p>x<!-- <p>no --> y</p><!-- open") == "x y"
    assert text("<p>a</i></div>b<table><tr><td>1<td>2<tr><td>3</table>") == "ab\n1\n2\n3"
    assert text("<div class=comments>no</div><form>q<input>r</form><p>1 < 2 &lt; 3 &#8364;&nbsp;4</p>") == "1 < 2 < 3 € 4"
    assert text("plain") == "plain" and text("") == "" and text("<p title='a>b'>t</p>") == "t"


def test_site_style_tree(spark):
    rows = []
    for k in range(40):
        body = f"<div class='x{k}'>Same banner</div><div class=m><p>Own text {k} of page</p><p>More {k * 7}</p></div><div>Legal line</div>"
        rows.append((k, f"http://one.org/{k}", f"<body>{body}</body>", "h"))
    rows += [(100, "http://two.org/", "<body><div>Legal line</div><p>once</p></body>", "h"), (101, None, None, "h"), (102, "::odd", "", None), (102, "::odd", "", None)]
    rows += [(200 + k, "http://three.org/p", "<article><p>copied article</p></article>", "h") for k in range(20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = html_text.extracted(pages).collect()
    text = {r["page_id"]: r["text"] for r in got}
    assert len(got) == len(rows) and text[3] == "Own text 3 of page\nMore 21"
    assert text[100] == "Legal line\nonce" and text[101] == text[102] == "" and text[205] == "copied article"
    assert html_text.extracted(pages.limit(0)).count() == 0


def test_importance_by_hand():
    rows = [(">b", 0, 0.0), (">b>d", 1, 0.0), (">b>p", 1, 1.0)]
    assert html_text.noise_of(rows) == [">b>d"]
    assert html_text.noise_of([(">b", 0, 0.0), (">b>d", 1, 0.1)]) == [">b"]
    assert html_text.noise_of([]) == []


def test_ways_of_reading_have_counts_of_their_own(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a  b"), (2, "a b"), (3, "a b"), (None, None), (4, ""), (5, "x" * 200_000)], "doc_id long, text string")
    cache = str(tmp_path / "cache")
    for whole in (False, True):
        got = {(r["doc_id"], r["n_tokens"]) for r in token_counts.counted(docs, cache, whole_texts=whole).collect()}
        assert {(1, 2), (2, 2), (3, 2), (None, 0), (4, 0)} < got and len(got) == 6
    rows = spark.read.parquet(cache).groupBy("version").count().collect()
    # three contents with white space folded, four without; nothing is counted again
    assert sorted(r["count"] for r in rows) == [3, 4]
    token_counts.counted(docs, cache, whole_texts=True).collect()
    assert spark.read.parquet(cache).count() == 7
