"""Main text of pages: the scan against brute force, odd markup, and the driver's pages."""

import random
from itertools import combinations

import pytest
from pyspark.sql import types as T

from papertrail.llm import html_region as hr

WEIGHTS = hr.fit_weights()


def test_scan_finds_the_largest_sum():
    rng = random.Random(8)
    for _ in range(300):
        scores = [rng.choice([-3, -2, -1, 0, 1, 2, 3]) for _ in range(rng.randint(0, 12))]
        first, last = hr.best_region(scores)
        best = max([0, *(sum(scores[a:b]) for a, b in combinations(range(len(scores) + 1), 2))])
        assert sum(scores[first:last + 1]) == best
    assert hr.best_region([]) == (0, -1) and hr.best_region([-1, 0]) == (0, -1)


def test_words_score_positive_and_tags_negative():
    assert WEIGHTS["word"] > 0
    assert all(v < 0 for k, v in WEIGHTS.items() if k != "word")


@pytest.mark.parametrize("source,text", [
    (None, ""), ("", ""), ("   \n", ""), ("<p></p>", ""), ("plain words only", "plain words only"),
    ("<div>a &lt;b&gt; &amp; c&nbsp;d &#233;&#x4E2D;</div>", "a <b> & c d é中"),
    ("<article><p>one\n two<p>three <b>bo</b>ld<br>next</article>", "one two\nthree bold next"),
    ("<nav><a href=x>Menu words here</a></nav><article><p>Body text here.</article><footer>Foot</footer>", "Body text here."),
    ("<article><p>First part of it.</p><div class='ad'>Buy this now please</div><p>Second part of it.</p></article>",
     "First part of it.\nSecond part of it."),
    ("<article><script>var a = '<p>no</p>';</script><style>p{}</style><!-- <p>hidden</p> --><p>Shown words.</p></article>", "Shown words."),
    ("<article><p>Kept text.</p><section id=comments><p>A reader says hello to all of you.</p></section></article>", "Kept text."),
    ("<nav>never closed <a href=1>x</a><article><p>Text goes on.</p></article>", "Text goes on."),
    ("<article><p class=\"notice\">Please note<p>The real text.</article>", "The real text."),
    ("<div a=\"unfinished><p>kept</p>", "kept"),
    ("a < b and c > d", "a < b and c > d"),
    ("<main><h1>T</h1><p>x</p></main>", "T\nx"),
    ("<main><p>The story.</p><div id='comments'><ol class='comment-list'><li><article class='comment-body'><p>I liked this story very much.</p>"
     "</article></li></ol></div><p>Its end.</p></main>", "The story.\nIts end."),
    ("<div class=content><p>The story.</p><div id=comments><ol class=comment-list><li><article class=comment-body><p>I liked this story very much."
     "</p></article></li></ol></div></div>", "The story."),
    ("<main><p>The story.</p><article class='comment'><p>I liked this story very much indeed.</p></article></main>", "The story."),
    ("<main><p>The story.</p></main><section class=comments><h1>What readers say</h1><p>I liked this story very much indeed.</p></section>", "The story."),
    ("<main><p>The story goes on and on.</p><aside><article><p>Another story that is told elsewhere.</p></article></aside></main>",
     "The story goes on and on."),
    ("<main><p>Seen text here.</p><p style='display: none'>Unseen</p><div style=\"color:red; display:none\"><p>Hidden text here</p></div></main>",
     "Seen text here."),
    ("<div id=comments><p>first</div><main><p>The story.</p></main>", "The story."),
    ("<article><form><p>Your name please</p></form><p>End of text.</p></article", "End of text."),
])
def test_pages(source, text):
    assert hr.main_text(source, WEIGHTS) == text


def test_labelled_pages_give_their_marked_text():
    for source in hr.LABELLED:
        marked = source.split(hr.CONTENT)[1].split(hr.END_CONTENT)[0]
        assert hr.main_text(source, WEIGHTS) == hr.main_text(f"<article>{marked}</article>", WEIGHTS)


def test_long_page_is_read_whole():
    words = "<p>" + "word " * 200_000 + "</p>"
    assert hr.main_text(f"<nav>a</nav><article>{words}</article>", WEIGHTS).count("word") == 200_000


def test_table_keeps_rows_and_columns(spark):
    schema = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()),
                           T.StructField("text", T.StringType()), T.StructField("extra", T.LongType())])
    rows = [(1, "u", "<article><p>Hello there.</p></article>", "clash", 5), (None, None, None, None, None),
            (1, "u", "<article><p>Hello there.</p></article>", "clash", 5), (2, "v", "", "clash", None)]
    out = hr.extract_main_text(spark.createDataFrame(rows, schema))
    assert out.columns == ["page_id", "url", "extra", "text", "n_chars"]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, [
        (1, "u", 5, "Hello there.", 12), (1, "u", 5, "Hello there.", 12), (None, None, None, "", 0), (2, "v", None, "", 0)]))
    assert hr.extract_main_text(spark.createDataFrame([], schema)).count() == 0


def sentence(word, n):
    return " ".join([word] * n)


@pytest.mark.parametrize("source", [
    "<div class=post><div class=intro>{a}</div><div class=newsletter>{no}</div><div class=text>{b}</div></div>",
    "<body><p>{a}</p><aside>{no}</aside><p>{b}</p></body>",
    "<body><p>{b}</p><form><p>{no}</p><button>Send</button></form><p>{a}</p></body>",
    "<article><div>{a}</div><nav><ul><li><a href=x>{no}</a></li></ul></nav><div>{b}</div></article>",
    "<main><section>{a}</section><ul><li><a href=x>{link}</a></li></ul><section>{b}</section></main>",
    "<div class=entry-content><section>{a}</section><ul><li><a href=x>{link}</a></li></ul><section>{b}</section></div>",
])
def test_article_split_by_something_long_is_whole(source):
    text = hr.main_text(source.format(a=sentence("before", 30), no=sentence("no", 60), b=sentence("behind", 200), link=sentence("link", 60)), WEIGHTS)
    assert text.count("before") == 30 and text.count("behind") == 200 and "no" not in text.split()


@pytest.mark.parametrize("source,text", [
    ("<body><div class='content has-sidebar'><p>Words of the text.</p></div></body>", "Words of the text."),
    ("<body><div class='main with-comments'><p>Words of the text.</p></div></body>", "Words of the text."),
    ("<body><div id=page-no-ads><p>Words of the text.</p></div></body>", "Words of the text."),
    ("<body><div class=widget><p>Words of the text.</p></div><p>End.</p></body>", "Words of the text.\nEnd."),
    ("<article><div class=article-header><h1>Title</h1></div><p>Words of the text.</p></article>", "Title\nWords of the text."),
    ("<article><p>Words of the text.</p><section id=search-results><p>Found so much.</p></section></article>", "Words of the text.\nFound so much."),
    ("<article><p>Words of the text.</p><section id=related-work><p>Others did it.</p></section></article>", "Words of the text.\nOthers did it."),
    ("<article><p>Words of the text.</p><div class=site-sidebar>No</div><div class=ad-banner>No</div><div id=sidebar-left>No</div></article>",
     "Words of the text."),
    ("<article><p>Words.</p><div class='box ad'>Buy this now and buy more of it</div></article>", "Words."),
    ("<div class=post><p>Words.</p></div><div class=comments><p>Readers write more than the author.</p></div>", "Words."),
])
def test_names_of_wrappers(source, text):
    assert hr.main_text(source, WEIGHTS) == text
