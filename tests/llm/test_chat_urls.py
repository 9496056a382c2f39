"""Chat perspectives and the URL filter: odd rows and what SQL doesn't show."""

import pytest

from hvspark.llm import chat, urls


@pytest.fixture(scope="module")
def turns(spark):
    rows = [
        (1, 0, "system", "be kind", "x"),
        (1, 1, "ann", "hi <|im_end|> all", "x"),
        (1, 2, "bob", None, "x"),
        (1, 3, "ann", "bye", "x"),
        (1, 3, "ann", "bye", "x"),
        (2, 0, "system", "alone", "x"),
        (3, None, None, "who", "x"),
        (None, 0, "cid", "", "x"),
    ]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, parts string")


def test_every_participant_is_the_assistant_once(turns):
    got = {(r.conv_id, r.perspective): r for r in chat.perspectives(turns).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (3, "unknown"), (None, "cid")}
    ann, bob = got[1, "ann"], got[1, "bob"]
    assert (ann.n_turns, ann.n_own, bob.n_own) == (5, 3, 1)
    assert [ann.rendered[s.start : s.end] for s in ann.mask] == ["hi <im_end> all<|im_end|>", "bye<|im_end|>", "bye<|im_end|>"]
    assert [bob.rendered[s.start : s.end] for s in bob.mask] == ["<|im_end|>"]
    assert "user name=bob\n" in ann.rendered and "user name=ann\n" in bob.rendered and "name=system" not in ann.rendered
    assert ann.rendered.startswith("<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi")


def test_long_and_empty_conversations(turns, spark):
    rows = [(7, i, f"p{i % 3}", "word " * 50) for i in range(2000)]
    got = chat.perspectives(spark.createDataFrame(rows, turns.drop("parts").schema)).collect()
    assert len(got) == 3 and sum(r.n_own for r in got) == 2000
    assert all(r.rendered[s.start : s.end] == "word " * 50 + chat.END for r in got for s in r.mask)
    assert chat.perspectives(turns.limit(0)).count() == 0


@pytest.mark.parametrize(
    "url, terms, reject",
    [
        ("http://a.com/porn", "porn", True),
        ("http://a.com/sporn/pornx", "", False),
        ("http://a.com/xxx1", "xxx", True),
        ("http://FREE-Sex.com/", "free free-sex sex", True),
        ("http://a.com/free/free/free", "free", False),
        ("http://a.com/free_poker", "free poker", True),
        ("http://a.com/free/download", "download free", False),
        ("http://a.com/erotic", "erotic", False),
        ("http://a.com/%70orn%2Fx", "porn", True),
        ("http://x.com/%ff%zz%", "", False),
        ("http://pornhub.com/a", "porn", True),
        ("http://www.cheapviagra.com", "viagra", True),
        ("http://milford.com/a/pornhub", "", False),
        ("http://a.xporny.com", "", False),
        ("http://a.com/freepoker", "", False),
        ("http://spam-farm.example.org/en", "farm spam spam-farm", True),
        ("http://farming.org/classic", "", False),
        ("", "", False),
        (None, "", False),
    ],
)
def test_terms_are_bounded(url, terms, reject):
    got = urls.Vocabulary().judge(url)
    assert (got[3], got[4]) == (terms, reject)


def test_url_frames(spark):
    pages = spark.createDataFrame([(1, "http://casino.com", "a"), (1, "http://casino.com", "a"), (2, None, None), (3, "x" * 100_000, "b")], "page_id long, url string, terms string")
    got = urls.filter_urls(pages)
    assert got.columns == [*pages.columns, "_verdict"]
    assert [r._verdict.reject for r in got.orderBy("page_id").collect()] == [True, True, False, False]
    assert urls.filter_urls(pages.limit(0)).count() == 0
    again = urls.filter_urls(got)
    assert again.columns == got.columns and again.count() == 4
    assert urls.Vocabulary(()).judge("http://porn.com") == (0, 0, 0.0, "", False)
    table = spark.createDataFrame([("a1", True, 0.0, False), ("A1", False, 3.0, False), ("b", False, 2.5, False), ("c", False, 2.5, False), ("", True, 0.0, False)], "term string, strict boolean, weight double, host boolean")
    v = urls.Vocabulary(urls.terms_of(table), 5)
    assert v.judge("x/A1/12-b")[:3] == (1, 1, 2.5) and v.judge("b/c")[4] and not v.judge("b/b")[4]


def test_precision_and_recall_on_labelled_urls():
    bad = "http://pornhub.example/v http://www.best-casino.example/win http://x.example/escort-service http://x.example/free_poker/bonus http://free.example/sex/dating http://x.example/online-betting-jackpot http://viagra-shop.example/ http://x.example/warez/keygen http://hentai.example/ https://x.example/p?q=xxx http://loans.example/payday http://x.example/%63asino".split()
    good = "http://sussex.example/adult-education http://x.example/free/download http://x.example/credit/discount http://x.example/sports/win http://farm.example/eggs http://x.example/dating http://milford.example/ http://x.example/specialist http://essexpoker.example/news http://x.example/hack-week http://x.example/how-to-win-friends http://x.example/bonus-track http://cheap.example/flights".split()
    v = urls.Vocabulary()
    hits = [u for u in bad + good if v.judge(u)[4]]
    assert sum(u in bad for u in hits) / len(hits) >= 0.95 and sum(u in bad for u in hits) / len(bad) >= 0.95
