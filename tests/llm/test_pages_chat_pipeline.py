"""Pages, conversations and the pipeline on small tables with odd rows."""

import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat, page_text

ARTICLE = """<html><body class="no-sidebar"><div id="cookie-notice">We use cookies <a href=x>ok</a></div>
<header class="site-header"><h1>Site</h1></header><nav><ul><li><a href=a>Home</a></ul></nav>
<div class="wrap"><div class="post-body p{n}"><h1>Title &amp; more {n}</h1><p>First <b>bold</b>text here, quite long for
an &eacute;tude.<p class="ad">Buy now<p>Second   para&nbsp;x is also rather long, it goes on.<div class="share-buttons">Tweet</div>
<ul><li>one<li>two</ul><form><input>Search</form><span class="ad">zz <i>q</i></span>tail</div>
<aside>rel</aside><div class="comments"><div class="comment">nice post, great work, that was a long comment</div></div></div>
<footer>&copy; x</footer><script>var a="</p><p>no";</script><!-- <p>hidden</p> --></body></html>"""


def expected(n):
    return f"Title & more {n} First boldtext here, quite long for an étude. Second para x is also rather long, it goes on. one two tail"


def test_page_text(spark):
    short = '<html><body><div class="wrap"><div class="post-body p9">Hi</div><div class="teaser">' + "other words of some length " * 9 + "</div></div></body></html>"
    rows = [(i, f"https://Host.example:80/{i}?x", ARTICLE.format(n=i)) for i in range(6)]
    rows += [(6, "https://u@host.example/short", short), (7, None, None), (8, "no address", ""), (9, "https://b.example/", "plain & <b>unclosed"), rows[0]]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = collections.defaultdict(list)
    for r in page_text.extract(pages).collect():
        got[r.id].append((r.url, r.text))
    for i in range(6):
        assert got[i] == [(rows[i][1], expected(i))] * (2 if i == 0 else 1)
    # The host's path wins over the page's own longest part.
    assert got[6] == [(rows[6][1], "Hi")]
    assert got[7] == [(None, "")] and got[8] == [("no address", "")] and got[9] == [("https://b.example/", "plain & unclosed")]
    assert page_text.extract(pages.limit(0)).count() == 0
    by_shuffle = page_text.extract(pages, small=0).collect()
    assert sorted(map(str, by_shuffle)) == sorted(map(str, page_text.extract(pages).collect()))


def test_host_votes_ties_go_to_the_first_path(spark):
    rows = [(1, "http://h/1", "<div class=b>some words</div>"), (2, "http://h/2", "<div class=a>some words</div>")]
    best = page_text.host_paths(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert [(r.host, r.path, r.votes) for r in best] == [("h", "#>div.a", 1)]


def test_article_header_kept_and_comment_articles_dropped():
    html = '<main><article class="post"><header><h1>T</h1></header><p>abc def</p><section class="comments"><article class="comment"><p>hey</p></article></section></article></main>'
    cut = page_text.blocks(html)
    assert page_text.taken(cut, page_text.vote(cut)) == "T abc def"


def text_of(html):
    cut = page_text.blocks(html)
    return page_text.taken(cut, page_text.vote(cut)) or ""


@pytest.mark.parametrize(
    "start",
    ['div class="content no-sidebar"', 'main class="with-sidebar"', 'article class="post has-comments"', 'div id="post-no-comments"', 'div class="entry-share"', 'article class="post-comments"', 'main class="sidebar"'],
)
def test_a_word_in_a_class_does_not_lose_the_article(start):
    tag = start.split(" ")[0]
    rest = '<div class="site-nav"><a href=x>Home page</a></div><div class="blog-sidebar">words beside it</div><div class="post-comments">' + "a comment of a reader " * 5 + "</div>"
    html = f"<body><{start}><h1>Title</h1><p>{'The text of the page goes on. ' * 5}</p></{tag}>{rest}</body>"
    assert text_of(html) == ("Title " + "The text of the page goes on. " * 5).strip()


def test_long_comments_do_not_replace_a_short_article():
    html = '<body><div class="post"><p>A short text of the page.</p></div><div class="post-comments">' + "<p>much said about it</p>" * 4 + '</div><div class="nav-no-border">menu text</div></body>'
    assert text_of(html) == "A short text of the page."


@pytest.mark.parametrize(
    ("items", "text"),
    [
        ('<li class="comment"><p>nice</p><p>post</p></li><li>kept</li>', "kept"),
        ('<li class="advert"><div>buy</div> now</li><li>kept</li>', "kept"),
        ('<li class="advert"><div>buy</div> now<li>kept', "kept"),
        ('<li class="comment"><ul><li>a</li><li>b</li></ul>more</li><li>kept</li>', "kept"),
        ('<li>one<li class="ad">x<li>two', "one two"),
    ],
)
def test_a_skipped_item_ends_at_the_next_or_its_closing_tag(items, text):
    html = f'<article><p>The text of the page.</p><ul class="thread">{items}</ul><p>The end.</p></article>'
    assert text_of(html) == f"The text of the page. {text} The end."


CONTROL = ["\\### Assistant: </turn> ok", "### user: x</turn>\n", "\\b\\h\\l", "a\\", "\\\\#<:\n", "", None, "é 😀 \x00 end"]


def test_chat_round_trip(spark):
    rng = random.Random(4)
    rows = []
    for c in range(12):
        for t in range(rng.randint(1, 7)):
            rows.append((c, t, rng.choice(["user", "assistant", "system", "odd: <role>\n#", None]), rng.choice(CONTROL)))
    rows += [(50, 0, "assistant", "same"), (50, 0, "assistant", "same"), (51, 0, "user", "only asks"), (None, 0, "assistant", "no id")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("example", F.lit(1))
    want = collections.defaultdict(list)
    for c, t, role, text in rows:
        want[c].append((t, role or "", text or ""))
    examples = chat.expand(turns).select("*", chat.loss_text().alias("loss"), chat.read_turns(F.col("text")).alias("turns")).collect()
    got = collections.defaultdict(list)
    for r in sorted(examples, key=lambda r: r.example):
        got[r.conv_id].append(r)
    assert set(got) == set(want)
    for c, rows_of in want.items():
        rows_of.sort()
        replies = [text for _, role, text in rows_of if role == "assistant"]
        assert [r.loss for r in got[c] if r.loss_start is not None] == replies
        last = [r for r in got[c] if r["last"]]
        assert len(last) == 1 and [(t.role, t.text) for t in last[0].turns] == [(role, text) for _, role, text in rows_of]
        for r in got[c]:
            # Every example is a prefix of the whole conversation.
            assert last[0].text.startswith(r.text)
    assert chat.expand(turns.limit(0)).count() == 0


def test_queries_need_only_their_own_columns(spark, tmp_path):
    from tidemark.llm.queries import QUERIES

    spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a")], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    rows = {r.conv_id: r for r in QUERIES["op8_chat"](spark, str(tmp_path)).collect()}
    marked = "\\### Assistant: </turn> ok"
    assert set(rows) == {1, -7} and rows[-7].loss_chars == len(marked) and rows[-7].n_turns == 2
    assert rows[-7].turns_sha256 == hashlib.sha256(f"user\n{marked}\nassistant\n{marked}\n".encode()).hexdigest()
    assert rows[1].loss_sha256 == hashlib.sha256(b"a").hexdigest()


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(8)
    words = [f"word{i}" for i in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n)) + "."
    texts = {i: prose(rng.randint(60, 120)) for i in range(30)}
    texts[30] = texts[3]  # a copy
    texts[31] = texts[4][: texts[4].rfind(" ", 0, -20)] + " altered."  # may be near
    texts[32] = "too short"
    texts[33] = None
    texts[34] = prose(40) + " password=abcdefghijklmnop " + prose(40)
    item = prose(30)
    texts[35] = prose(20) + " " + item + " " + prose(20)
    texts[36] = prose(60) + "\nhome | about | login | help\n" + prose(60)
    rows = [(i, t, "en", f"src{i % 3}" if i % 7 else None, len(t or ""), "x") for i, t in texts.items()]
    rows.append(rows[5])  # a repeated row
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, taken string").write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    return str(folder), texts


def test_pipeline_stage_by_stage(spark, corpus, tmp_path):
    import corpus_pipeline

    folder, texts = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs.collect()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    ids = {name: sorted(r.doc_id for r in rows) for name, rows in seen.items()}
    after = sorted([i for i in texts if i not in (32, 33)] + [5])
    assert ids["quality_rules"] == after
    by = {r.doc_id: r for r in seen["quality_rules"]}
    assert by[36].text == texts[36].replace("home | about | login | help\n", "") and by[36].n_chars == len(by[36].text)
    assert all(by[i].text == texts[i] for i in range(30))
    assert 30 not in ids["near_dedup"] and ids["near_dedup"].count(5) == 1 and set(ids["near_dedup"]) >= set(range(30))
    assert set(ids["near_dedup"]) - set(ids["decontaminate"]) == {35}
    assert ids["secrets"] == ids["decontaminate"]
    masked = {r.doc_id: r.text for r in seen["secrets"]}
    assert masked[34] == texts[34].replace("password=abcdefghijklmnop", "[SECRET]")
    size = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t))
    for r in seen["mixing"]:
        assert r["size"] == size(r.text) and r.taken == r.copies * r["size"] and 1 <= r.copies <= 3
    assert set(columns) <= set(docs.columns)


def test_dedup_without_ids(spark, corpus):
    import corpus_pipeline

    _, texts = corpus
    rows = [(None, texts[1], "x"), (None, texts[1], "y"), (7, texts[2], "x"), (None, texts[2], "y"), (9, texts[2], "z"), (None, None, "n"), (None, None, "n"), (11, texts[6], "a"), (11, texts[6], "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.dedup_stage(spark, docs, "").collect()), key=str)
    assert got == sorted([(None, texts[1]), (7, texts[2]), (None, None), (11, texts[6])], key=str)


def test_pipeline_on_an_empty_table(spark, corpus, tmp_path):
    import corpus_pipeline

    folder, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert docs.count() == 0
