import collections
import re

import pytest

from twinline.llm import terms
from twinline.llm.terms import TermCounts
from twinline.session import new_path

SCHEMA = "id long, text string, repo string, s string, term string, o int"
OLD = [(1, "Ab ab a_1 ß", "r/x"), (2, "ab K", None), (3, None, "r/x"), (4, "", ""), (5, "!!", "r/y"), (5, "!!", "r/y"), (6, "w " * 20_000, "r/x")]


def table(rows, data):
    return rows([(*x, "clash", "clash", 1) for x in data], SCHEMA)


def brute(data):
    occ, docs = collections.Counter(), collections.Counter()
    n = {"text": 0, "repo": 0}
    for _, text, repo in data:
        if text is not None:
            n["text"] += 1
            found = re.findall("[A-Za-z0-9_]+", text)
            found = ["".join(c.lower() if c.isascii() else c for c in t) for t in found]
            occ.update(("text", t) for t in found)
            docs.update(("text", t) for t in set(found))
        if repo is not None:
            n["repo"] += 1
            occ["repo", repo] += 1
            docs["repo", repo] += 1
    mark = lambda k: "too_rare" if docs[k] < 3 else "too_common" if docs[k] * 10 > n[k[0]] else None
    return {(*k, occ[k], docs[k], mark(k)) for k in occ}


def got(counts):
    return {tuple(r) for r in counts.terms().collect()}


@pytest.fixture
def counts(spark):
    return TermCounts(spark, new_path(spark, "t"), ["text"], ["repo"], bucket_rows=4)


def test_counts_and_increments(rows, counts):
    assert got(counts) == set()
    counts.update(added=table(rows, OLD))
    assert got(counts) == brute(OLD)
    assert counts.manifest()["buckets"] > 1  # as many as the state asks for
    # One record changes, one goes, two come; terms that vanish leave the state.
    changed, gone, new = [(1, "ab b", "r/z")], [OLD[4]], [(7, "ab new", "r/x"), (8, "ab", "r/x")]
    counts.update(added=table(rows, changed + new), deleted=table(rows, [OLD[0], *gone]))
    now = [*changed, *OLD[1:4], *OLD[5:], *new]
    assert got(counts) == brute(now)
    counts.update(deleted=table(rows, now))
    assert got(counts) == set()
    counts.update(added=table(rows, OLD[:1]))
    assert got(counts) == brute(OLD[:1])


def test_nothing(rows, counts):
    counts.update()
    counts.update(added=table(rows, []))
    assert got(counts) == set()


def test_a_batch_counts_once(rows, counts):
    assert counts.update(added=table(rows, OLD), source="s", batch=3)
    assert not counts.update(added=table(rows, OLD), source="s", batch=3)
    assert not counts.update(added=table(rows, OLD), source="s", batch=2)
    assert got(counts) == brute(OLD)
    assert counts.update(added=table(rows, OLD[:1]), source="other", batch=0)
    assert got(counts) == brute([*OLD, OLD[0]])


def test_readers_and_crashes_see_whole_states(spark, rows, counts, monkeypatch):
    counts.update(added=table(rows, OLD))
    before = counts.read()  # a reader that starts now and ends after the next change
    want = {tuple(r) for r in before.collect()}

    def crash(manifest):
        raise OSError("gone before the manifest was published")

    with monkeypatch.context() as m:
        m.setattr(counts, "_publish", crash)
        with pytest.raises(OSError):
            counts.update(added=table(rows, OLD))
    assert got(counts) == brute(OLD)
    counts.update(added=table(rows, OLD[:2]))
    assert {tuple(r) for r in before.collect()} == want
    assert got(counts) == brute([*OLD, *OLD[:2]])
    # Two writers that start from the same state: the second fails, and nothing is lost.
    old = counts.manifest()
    counts.update(added=table(rows, OLD[:1]))
    with pytest.raises(RuntimeError):
        counts._publish({**old, "version": old["version"] + 1})
    assert got(counts) == brute([*OLD, *OLD[:2], OLD[0]])
    assert len(counts.versions()) <= terms.KEEP + 1
