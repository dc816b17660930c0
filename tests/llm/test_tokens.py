import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from twinline.llm import encoding, packing

if not os.path.exists(os.path.join(encoding.TOKENIZERS, f"{encoding.NAME}.tiktoken")):
    pytest.skip("no vocabulary files", allow_module_level=True)


@pytest.fixture(scope="module")
def enc():
    return encoding.encoder(encoding.TOKENIZERS, encoding.NAME)


PIECES = ["'", "'s", "'ll", "a", "B", "é", "的", "  ", "\n", "\t", " ", "1", "२", "!", "?", "👩‍💻", "'t", " ", "　", ".", "don't", "é", "<|endoftext|>", "hello world"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PIECES), st.text(max_size=3)), max_size=40), st.integers(1, 9))
def test_halves_give_the_ids_of_the_whole(enc, parts, leaf):
    text = "".join(parts).encode("utf-8", "replace").decode()
    ids = encoding.encode(enc, text, leaf)
    assert ids == enc.encode_ordinary(text)
    assert encoding.decode(enc, ids).decode() == text


def test_ordinary_documents_are_joined_of_halves(enc, monkeypatch):
    joined = []
    join = encoding.join
    monkeypatch.setattr(encoding, "join", lambda *a: joined.append(1) or join(*a))
    text = "Feature: a cart\n  Given an item isn't sold out\n" * 25
    assert 1000 < len(text) < 1500 and encoding.encode(enc, text) == enc.encode_ordinary(text)
    assert joined


@pytest.mark.parametrize("text", ["a" * 50_000, "日本語" * 9000, " " * 30_000, "word " * 20_000, "'" * 20_000, "x1" * 20_000, "\n\n" * 9000 + "end"])
def test_very_long_texts(enc, text):
    assert encoding.encode(enc, text) == enc.encode_ordinary(text)


def test_the_other_library_agrees(enc):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(os.path.join(encoding.TOKENIZERS, f"{encoding.NAME}.json"))
    t.encode_special_tokens = True
    for text in ["Feature: x\n  Given “it” isn't 12 €", "<|endoftext|> ok", "フィーチャ: 座席表"]:
        assert encoding.encode(enc, text, 3) == t.encode(text, add_special_tokens=False).ids


def test_columns(rows, enc):
    data = [(1, "hello world", "x"), (2, "", "x"), (3, None, "x"), (None, "a", "x"), (4, "日本" * 9000, "x"), (4, "again", "x")]
    df = rows(data, "doc_id int, text string, ids string")
    ids = encoding.encode_column(df, "doc_id", "text")
    got = sorted(((r.doc_id, r.ids) for r in ids.collect()), key=str)
    assert got == sorted(((i, enc.encode_ordinary(t or "")) for i, t, _ in data), key=str)
    back = sorted(((r.doc_id, r.text) for r in encoding.decode_column(ids, "doc_id", "ids").collect()), key=str)
    assert back == sorted(((i, t or "") for i, t, _ in data), key=str)
    assert encoding.encode_column(df.limit(0), "doc_id", "text").count() == 0


def test_fill_keeps_all_limits():
    rng = np.random.default_rng(0)
    demand = np.column_stack([np.sort(rng.integers(1, 2049, 3000))[::-1], np.ones(3000, int), rng.integers(0, 200, 3000)])
    demand[:, 2] = np.minimum(demand[:, 2], demand[:, 0])
    bounds = np.array([2048, 4, 300])
    where = packing.fill(demand, bounds)
    sums = np.zeros((where.max() + 1, 3))
    np.add.at(sums, where, demand)
    assert (sums <= bounds).all() and (sums[:, 0] > 0).all()
    tokens = np.sort(rng.integers(20, 900, 4000))[::-1]
    where = packing.fill(np.column_stack([tokens, np.ones(4000, int), tokens]), np.array([2048, 64, 2048]))
    assert tokens.sum() / ((where.max() + 1) * 2048) > 0.99
    assert packing.fill(np.zeros((0, 3), int), bounds).size == 0


def test_pack(rows):
    data = [(i, n, min(n, 3)) for i, n in enumerate([5000, 2048, 100, 1, 0, 1948, 2047, 100, 100])] + [(None, 7, 1), (2, 100, 3)]
    df = rows([(*d, "clash", 1) for d in data], "doc_id long, n_tokens int, n_prompt int, shard string, n int")
    got = packing.pack(df, "doc_id").collect()
    by_item = {}
    for r in got:
        by_item.setdefault(r.doc_id, []).append((r.part_no, r.start_token, r.n_tokens))
    assert sorted(by_item[0]) == [(0, 0, 2048), (1, 2048, 2048), (2, 4096, 904)]
    assert by_item[1] == [(0, 0, 2048)] and len(by_item[2]) == 2 and by_item[None] == [(0, 0, 7)]
    assert [(r.container_id, r.n_tokens) for r in got if r.doc_id == 4] == [(None, 0)]
    sums = {}
    for r in got:
        if r.container_id is not None:
            sums[r.container_id] = sums.get(r.container_id, 0) + r.n_tokens
    assert max(sums.values()) <= 2048 and sum(sums.values()) == sum(n for _, n, _ in data)
    assert packing.pack(df.limit(0), "doc_id").count() == 0


def test_items_with_much_loss_stay_whole(rows):
    """A short item is never split, whatever its loss-bearing tokens; beside one with more than the limit there are none."""
    data = [(1, 1900, 0), (2, 100, 100), (3, 100, 0), (4, 1500, 200), (5, 2048, 2048), (6, 900, 100), (7, 900, 100)]
    df = rows(data, "doc_id long, n_tokens int, n_prompt int")
    got = {r.doc_id: (r.container_id, r.n_tokens, r.n_loss) for r in packing.pack(df, "doc_id", loss=800).collect()}
    assert {i: g[1] for i, g in got.items()} == {i: n for i, n, _ in data}
    inside = {}
    for i, (c, _, loss) in got.items():
        inside.setdefault(c, []).append(min(loss, 800))
    assert all(sum(x) <= 800 for x in inside.values()) and got[1][0] != got[3][0] and got[6][0] != got[7][0]


def test_prompts():
    assert [packing.prompt_bytes(t) for t in ("one block\nof text", "a\n\nb", "é\n \n\n b\nc\n\n", "", "\n\n", "\n\na")] == [0, 3, 7, 0, 0, 2]


def test_sizes(rows, enc):
    df = rows([(1, "a title\n\nand a text"), (2, None), (3, ""), (4, "one block\nonly")], "doc_id long, text string")
    got = {r.doc_id: (r.n_tokens, r.n_prompt) for r in packing.sizes(df, "doc_id", "text").collect()}
    assert got == {1: (len(enc.encode_ordinary("a title\n\nand a text")), 4), 2: (0, 0), 3: (0, 0), 4: (len(enc.encode_ordinary("one block\nonly")), 0)}
