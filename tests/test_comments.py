"""Comments from their log."""

import datetime as dt

from veritrace.operators import comments, upsert


def test_comments(spark):
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    log = [
        ("1", None, "e", "ann", "see @Company:77 and @Company:77", "create", t(1)), ("1", None, None, "bob", "hacked", "update", t(2)), ("1", None, None, "ann", "see @Tender:Z1", "update", t(3)),
        ("2", "1", "e", "bob", "first reply", "create", t(5)), ("3", "1", "e", "bob", "early reply", "create", t(4)), ("4", None, "e", "bob", "gone", "create", t(4)), ("4", None, None, "bob", None, "delete", t(6)),
        ("5", None, "e", "cid", "  ", "create", t(4)), ("6", None, "f", "cid", "other Reply", "create", t(4)), ("6", None, None, "cid", "too early", "update", t(0)),
    ]
    c = comments.state(spark.createDataFrame(log, comments.LOG))
    by = {r["comment_id"]: r for r in c.collect()}
    assert sorted(by) == ["1", "2", "3", "6"] and by["1"]["mentions"] == ["Z1"] and by["1"]["edited"] and not by["6"]["edited"]
    assert [r["comment_id"] for r in comments.page(c, "e", 2, 0).collect()] == ["2", "3"]
    assert sorted(r["comment_id"] for r in comments.search(c, "REPLY").collect()) == ["2", "3", "6"] and comments.search(c, "reply first", "bob").count() == 1
    got = {r["comment_id"]: (r["replies"], r["shown"]) for r in comments.threads(c).collect()}
    assert got == {"1": (2, ["3", "2"]), "6": (0, [])} and comments.threads(c, 1).where("comment_id = '1'").first()["shown"] == ["3"]


def test_link_diff(spark):
    a = spark.createDataFrame([(1, "W", 2, 5), (1, "W", 3, 5), (1, "O", 3, 1)], "src long, kind string, dst long, v int")
    b = spark.createDataFrame([(1, "W", 2, 6), (1, "W", 4, 5), (1, "O", 3, 1)], "src long, kind string, dst long, v int")
    assert sorted(map(tuple, upsert.link_diff(a, b, ("v",)).collect())) == [(1, "W", 2, "changed"), (1, "W", 3, "removed"), (1, "W", 4, "added")]
    assert upsert.link_diff(a, b).count() == 2
