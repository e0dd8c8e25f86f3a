import random
from collections import Counter

from nightjar.llm.lines import BLANK, remove_boilerplate


def brute(rows, min_sites):
    sites, first = {}, {}
    for d, t, s in rows:
        for x in (t or "").split("\n"):
            k = x.strip(BLANK)
            if k:
                sites.setdefault(k, set()).add(s or "")
                if d is not None:
                    first[k] = min(first.get(k, d), d)
    out = []
    for d, t, _ in rows:
        lines = [] if t is None else t.split("\n")
        kept = [x for x in lines if not (k := x.strip(BLANK)) or len(sites[k]) < min_sites or first.get(k) == d]
        out.append((d, len(lines), len(lines) - len(kept), None if t is None else "\n".join(kept)))
    return sorted(out, key=str)


def got(df):
    return sorted([(r.doc_id, r.n_lines, r.n_removed, r.text) for r in df.collect()], key=str)


def test_spread_around_the_threshold(make_docs):
    rows = []
    for line, n_sites in (("nine", 9), ("ten", 10), ("eleven", 11), ("twelve", 12), ("many", 60)):
        rows += [(len(rows) + i, f"own {line} {i}\n {line}\t\n\nend {line} {i}", f"s{i}") for i in range(n_sites)]
    rows += [(1000 + i, "often on one site", "s1") for i in range(50)]
    assert got(remove_boilerplate(make_docs(rows), 10)) == brute(rows, 10)


def test_edge_rows(make_docs):
    rows = [(i, "dull line\nä ö", f"s{i % 4}") for i in range(8)]
    rows += [(20, None, "s1"), (21, "", "s2"), (22, "\n\n", None), (None, "dull line\nx", "s3"), (3, "dull line", "s3"),
             (3, "dull line", "s3"), (30, "y " * 300_000 + "\ndull line", None)]
    df = make_docs(rows).selectExpr("*", "1 as n_lines", "2 as h1", "'q' as site", "3 as _doc", "4 as _doc2",
                                   "5 as _gone", "6 as h2", "7 as doc")
    out = remove_boilerplate(df, 4)
    assert got(out) == brute(rows, 4)
    assert set(out.columns) >= {"h1", "site", "_doc", "lang", "source"}
    assert remove_boilerplate(make_docs(rows).limit(0), 4).count() == 0


def test_verdict_does_not_depend_on_size(make_docs):
    """A footer on 6 of 9 sites goes; a short line that chance puts on every
    site stays, at either size; a short one far beyond chance goes."""
    for n in (400, 1600):
        rnd, rows = random.Random(n), []
        for i in range(n):
            t = [" ".join(rnd.choice(["it", "was", *(f"w{j}" for j in range(30))]) for _ in range(rnd.randint(4, 9)))
                 for _ in range(3)]
            t.append(rnd.choice(["It.", "Was.", *(f"W{j}." for j in range(30))]))
            t += ["zu und"] * (i % 9 == 0) + ["Rights of w1 w2 reserved"] * (i % 9 < 6 and i % 4 == 0)
            rows.append((i, "\n".join(t), f"s{i % 9 if i % 18 else i // 18 % 9}"))
        docs = make_docs(rows)
        out = remove_boilerplate(docs, 5, excess=10, min_docs=10).collect()
        left = Counter(x for r in out for x in r.text.split("\n"))
        assert left["Rights of w1 w2 reserved"] == left["zu und"] == 1
        assert left["It."] == sum(t.split("\n").count("It.") for _, t, _ in rows) > n / 64
        assert sum(r.n_removed for r in out) == sum(
            t.split("\n").count(x) for _, t, _ in rows for x in ("zu und", "Rights of w1 w2 reserved")) - 2


def test_sites_and_documents_asked_for(make_docs):
    rows = [(i, f"own {i}\nthe footer", f"s{i % 3}") for i in range(9)]
    few = remove_boilerplate(make_docs(rows), 2, excess=10, min_docs=10).collect()
    assert sum(r.n_removed for r in few) == 0
    rows += [(9, "own 9\nthe footer", None), (10, None, "s1"), (None, "the footer\n---", "s2")]
    rows += [(20 + i, f"own {i}\n---", f"s{i % 3}") for i in range(10)]
    out = remove_boilerplate(make_docs(rows), 2, excess=10, min_docs=10).collect()
    left = Counter(x for r in out for x in (r.text or "").split("\n"))
    assert left["the footer"] == left["---"] == 1
    assert remove_boilerplate(make_docs(rows).limit(0), 2, excess=10, min_docs=10).count() == 0


def test_one_line_that_is_much_of_the_corpus(make_docs):
    """A long line that makes up most words: what chance allows is reckoned
    without it, so it is found however many words it has."""
    long = " ".join(["over", "and"] * 40)
    rows = [(i, f"{long}\nown w{i} over and", f"s{i % 6}") for i in range(30)]
    out = remove_boilerplate(make_docs(rows), 5, excess=10, min_docs=10).collect()
    assert sum(long in r.text for r in out) in (1, 30)  # all by chance, or all but the first
    spread = [(i, f"{long} w{j}" if i % 2 else f"own w{i}", f"s{i % 6}") for i, j in ((k, k % 3) for k in range(60))]
    got = remove_boilerplate(make_docs(spread), 2, excess=10, min_docs=5).collect()
    assert all(r.text is not None for r in got)
