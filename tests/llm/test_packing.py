import numpy as np
import pytest

from lexloom.llm.packing import BITS, CAPACITY, hilbert_keys, pack_texts
from lexloom.llm.queries import VOCABULARY

public_tokenizers = pytest.importorskip("public_tokenizers")


def encode(text):
    from lexloom.llm.packing import _encoding, read_ranks

    return _encoding(read_ranks(VOCABULARY), public_tokenizers.PATTERN).encode_ordinary(text)


@pytest.mark.parametrize("bits,dims", [(3, 2), (2, 3), (2, 4)])
def test_hilbert_curve_visits_every_cell_in_single_steps(bits, dims):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    keys = hilbert_keys(cells, bits)
    assert sorted(keys) == list(range(len(cells)))
    steps = np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1)
    assert (steps == 1).all()
    assert BITS * 3 < 63


def check(rows, texts, capacity):
    filled, pieces = {}, {}
    for c, doc, piece, start, n, _ in rows:
        filled[c] = filled.get(c, 0) + n
        pieces.setdefault(doc, []).append((piece, start, n))
    assert all(0 < n <= capacity for n in filled.values())
    for doc, text in texts.items():
        if text is None or not text.strip():
            assert doc not in pieces
            continue
        total, mine = len(encode(text)), sorted(pieces[doc])
        assert [p for p, _, _ in mine] == list(range(-(-total // capacity)))
        assert [s for _, s, _ in mine] == [i * capacity for i in range(len(mine))] and sum(n for _, _, n in mine) == total
        assert len(mine) == 1 or all(n == capacity for _, _, n in mine[:-1])
    return sum(filled.values()) / (len(filled) * capacity)


def best_fit(sizes, capacity):
    """Share of room used by best fit decreasing over all pieces at once."""
    rooms = []
    for size in sorted(sizes, reverse=True):
        fits = [x for x in rooms if x >= size]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - size)
        else:
            rooms.append(capacity - size)
    return sum(sizes) / (len(rooms) * capacity)


def test_every_text_once_and_little_room_left(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = [tuple(r) for r in pack_texts(docs, VOCABULARY, public_tokenizers.PATTERN).collect()]
    used = check(rows, texts, CAPACITY)
    total = sum(r[4] for r in rows)
    assert used > 0.95 or len({r[0] for r in rows}) <= -(-total // CAPACITY) + 1


def test_many_ranges_and_small_containers(spark):
    texts = {i: "wort " * (1 + i * 7 % 150) for i in range(300)} | {1000: "lang " * 5000, 1001: "", 1002: None, 1003: " \n\t", 1004: "x"}
    df = spark.createDataFrame([(k, v, "extra", 5) for k, v in texts.items()], "doc_id int, text string, container_id string, n_tokens int")
    rows = [tuple(r) for r in pack_texts(df, VOCABULARY, public_tokenizers.PATTERN, capacity=200, range_rows=40).collect()]
    assert check(rows, texts, 200) > 0.95 * best_fit([r[4] for r in rows], 200)


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "ein text"), (1, "ein text")], "doc_id int, text string")
    assert pack_texts(df, VOCABULARY, public_tokenizers.PATTERN).count() == 2
    assert pack_texts(df.limit(0), VOCABULARY, public_tokenizers.PATTERN).count() == 0


def test_containers_hold_neighbours_on_the_curve(spark):
    from lexloom.llm.queries import p6_fill

    row = p6_fill(spark, "/root/testdata/sf0.1").head()
    assert row["used_share"] >= 0.98 and row["spread"] < 0.2 * row["random_spread"]
