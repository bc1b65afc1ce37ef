"""SimHash links are a step of near dedup, before MinHash."""

import random

from helixframe.llm import neardup, simhash
from tests.llm.test_neardup import kept


def rows():
    """Long texts in pairs that differ by their last word, and texts alike in nothing."""
    rng = random.Random(9)
    out = []
    for k in range(12):
        text = [f"w{rng.randrange(10**6)}" for _ in range(600)]
        out += [(10 + 2 * k, " ".join(text)), (11 + 2 * k, " ".join([*text[:-1], f"end{k}"]))]
    return out + [(100 + k, " ".join(f"u{rng.randrange(10**6)}" for _ in range(40))) for k in range(12)]


def distance(a, b):
    x, y = (int.from_bytes(simhash.majority(simhash.shingle_hashes(t.encode(), 5), 1)) for t in (a, b))
    return (x ^ y).bit_count()


def test_links_of_fingerprints_make_components_without_minhash(spark, monkeypatch):
    texts = dict(rows())
    near = {i for i in range(10, 34, 2) if distance(texts[i], texts[i + 1]) <= 3}
    assert len(near) > 6
    real = neardup.crowds
    monkeypatch.setattr(neardup, "crowds", lambda nodes: real(nodes).limit(0))
    found = {r.doc_id: r.component_id for r in neardup.near_copies(spark.createDataFrame(rows(), "doc_id long, text string").repartition(3)).collect()}
    assert {i for i, c in found.items() if c != i} == {i + 1 for i in near}


def test_whole_result_is_that_of_all_pairs(spark):
    found = neardup.near_copies(spark.createDataFrame(rows(), "doc_id long, text string").repartition(3)).collect()
    assert {r.component_id for r in found} == kept(rows())


def test_nodes_of_one_fingerprint_are_linked_in_a_line(spark):
    """Sets of one fingerprint, however many, give a link for each and not for each pair."""
    nodes = spark.createDataFrame([(f"{k:04d}".encode(), 1, "one two three") for k in range(500)], "key binary, n int, text string")
    links = neardup.fingerprint_links(nodes, text="text", shingle=5, percent=80).collect()
    assert 499 <= len(links) <= 499 + neardup.SALTS
    root = {bytes(r[x]): bytes(r[x]) for r in links for x in "ab"}
    for _ in range(500):
        before = dict(root)
        for r in links:
            root[bytes(r.a)] = root[bytes(r.b)] = min(root[bytes(r.a)], root[bytes(r.b)])
        if root == before:
            break
    assert len(root) == 500 and len(set(root.values())) == 1
