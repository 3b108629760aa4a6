"""The template tree of urls against a recursive form in plain Python."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from rankloom.llm import urls


def share(labelled, blocked, n, parent):
    return (blocked + (urls.SMOOTHING + n - labelled) * parent) / (n + urls.SMOOTHING)


def plain_tree(paths, base):
    """{raw path: (template, forks, purity of the last node)} of one host; paths: (segments, label or None) of its pages."""
    out = {}

    def walk(rows, done, template, forks, above):
        n, labels = len(rows), [y for _, y in rows if y is not None]
        p = (sum(labels) + urls.SMOOTHING * base) / (n + urls.SMOOTHING) if above is None else share(len(labels), sum(labels), n, above)
        shared = 0
        while all(len(r) > done + shared for r, _ in rows) and len({r[done + shared] for r, _ in rows}) == 1:
            template += "/" + rows[0][0][done + shared]
            shared += 1
        done += shared
        for r, _ in rows:
            if len(r) == done:
                out[r] = (template, tuple(forks), p)
        on = [(r, y) for r, y in rows if len(r) > done]
        count = Counter(r[done] for r, _ in on)
        most = max((t for t in count.values() if (few := [k for k in count.values() if k <= t]) and len(few) > urls.OPEN * math.sqrt(sum(few))), default=0)
        below = defaultdict(list)
        for r, y in on:
            below["*" if count[r[done]] <= most else r[done]].append((r, y))
        for part, part_rows in below.items():
            walk(part_rows, done + 1, f"{template}/{part}", [*forks, done], p)

    walk(paths, 0, "", [], None)
    return out


def tree_of(spark, rows):
    """rows: (host, segments, label)."""
    df = spark.createDataFrame([(h, "".join("/" + s for s in segments), y) for h, segments, y in rows], "host string, raw string, label int")
    return urls.templates(df)


@pytest.mark.parametrize("seed", range(3))
def test_tree_against_plain_form(spark, seed):
    draw = random.Random(seed)
    sections = ["en", "es", "fr", "user", "", "tag"]
    rows = []
    for host in ("a.org", "b.net", "c.com"):
        for _ in range(260):
            segments = [draw.choice(sections) for _ in range(draw.randrange(4))]
            if draw.random() < 0.6:
                segments.insert(draw.randrange(len(segments) + 1), f"name{chr(97 + draw.randrange(26))}{chr(97 + draw.randrange(26))}")
            label = None if draw.random() < 0.5 else int("es" in segments)
            rows.append((host, tuple(segments), label))
    rows += [("deep.org", tuple("abcdefghijkl"), 1), ("deep.org", tuple("abcdefghijklm"), None), ("", (), None)]
    labels = [y for _, _, y in rows if y is not None]
    got = {(r["host"], r["raw"]): r for r in tree_of(spark, rows).collect()}
    assert len(got) == len({(h, s) for h, s, _ in rows})
    for host in {h for h, _, _ in rows}:
        want = plain_tree([(s, y) for h, s, y in rows if h == host], sum(labels) / len(labels))
        for segments, (template, forks, p) in want.items():
            row = got[host, "".join("/" + s for s in segments)]
            assert (row["template"], tuple(row["forks"])) == (template, forks) and row["p"] == pytest.approx(p)


def test_names_become_one_wildcard_at_any_count(spark):
    """As many pages a name as one likes: names that grow with the pages are variable, a few sections are not."""
    name = lambda i: "u" + "".join(chr(97 + (i // 26**k) % 26) for k in range(3))
    rows = [("h.org", ("user", name(i), f"post{chr(97 + j)}"), None) for i in range(50) for j in range(10)]
    rows += [("s.org", (s, "x"), None) for s in ("news", "sport", "maps", "mail") for _ in range(200)] + [("s.org", (name(i), "x"), None) for i in range(40)]
    tree = tree_of(spark, rows)
    assert {r["template"] for r in tree.where("host = 'h.org'").collect()} == {f"/user/*/post{chr(97 + j)}" for j in range(10)}
    assert {r["template"] for r in tree.where("host = 's.org'").collect()} == {"/news/x", "/sport/x", "/maps/x", "/mail/x", "/*/x"}


def test_branches_merge_below_the_first_segment(spark):
    """Similar branches of the third segment pool their labels, those of the other side stay apart."""
    rows = [("m.net", ("shop", "list", s, "p"), y) for s, y in (("red", 1), ("blue", 1), ("green", 0), ("grey", 0)) for _ in range(8)]
    rows += [("m.net", ("shop", "list", "lone", "q"), 1)] * 8
    got = {r["template"]: r for r in urls.verdicts(tree_of(spark, rows)).collect()}
    red, blue, green, lone = (got[f"/shop/list/{s}"] for s in ("red/p", "blue/p", "green/p", "lone/q"))
    assert red["branch"] == blue["branch"] == "/shop/list/<blocked>/p" and (red["labelled"], red["blocked"]) == (16, 16)
    assert green["branch"] == got["/shop/list/grey/p"]["branch"] == "/shop/list/<allowed>/p" and green["blocked"] == 0
    assert lone["branch"] == "/shop/list/lone/q" and lone["labelled"] == 8 and red["rejected"] and not green["rejected"]


def test_odd_rows(spark):
    """Null page_ids, repeated rows, very long and very deep paths, columns with clashing names."""
    long = "http://l.org/" + "a/" * 20_000
    rows = [(None, long), (None, long), (1, long + "b"), (1, "http://l.org/" + "z" * 200_000), (2, ""), (3, "://"), (4, "http:///x"), (5, None)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    for name in ("host", "path", "rule", "template", "n", "p", "label", "_h", "forks", "a.b"):
        df = df.withColumn(name, F.lit("clash"))
    got = urls.judge(df, urls.RULES).collect()
    assert Counter(r["page_id"] for r in got) == Counter(r[0] for r in rows) and all(r["verdict"] == "allow" for r in got)
    assert {r["template"] for r in got if r["page_id"] is None} == {"/" + "a/" * 20_000}
    assert [(r["host"], r["path"]) for r in got if r["page_id"] == 4] == [("", "/x")]
