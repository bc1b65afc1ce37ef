import random

from pyspark.sql import functions as F

from helixframe.functions import dna
from helixframe.operators import consensus, graph, reads, repeats, simplify, stats
from helixframe.plans.assemble import assemble
from helixframe.plans.config import Config
from helixframe.sources import formats

NODES = "node_id string, seq string, cov double"
EDGES = "src string, src_dir string, dst string, dst_dir string, ovl int"
FLIP = {"f": "r", "r": "f"}


def both(edges):
    return sorted(set(edges) | {(d, FLIP[y], s, FLIP[x], o) for s, x, d, y, o in edges})


def test_dna(spark):
    r = spark.createDataFrame([("AACCGGTA",), ("ACGTA",), ("",), ("ACGNT",)], "s string")
    got = [tuple(x) for x in r.select(dna.rc("s"), dna.dna_pack("s"), dna.dna_unpack(dna.dna_pack("s"))).collect()]
    assert got[0][::2] == ("TACCGGTT", "AACCGGTA") and got[1][1] == "COA" and got[1][2] == "ACGTA" and got[2] == ("", "", "") and got[3][0] == "ACGT"
    flips = spark.range(1).select(*[dna.flip_link(F.lit(e)) for e in ("ff", "fr", "rf", "rr")]).first()
    assert tuple(flips) == ("rr", "fr", "rf", "ff")
    near = spark.createDataFrame([("ACGTACGTAC" * 3, "ACGTACGTAC" * 2 + "ACGTACGTAG"), ("A" * 30, "C" * 30), ("ACGT" * 400, "ACGT" * 401)], "a string, b string")
    assert [x[0] for x in near.select(dna.similar("a", "b")).collect()] == [True, False, True]


def test_reads(spark):
    raw = spark.createDataFrame([("r2", "TACCGGTT"), ("r1", "aaccggta"), ("r3", "AACCGGTA"), ("n", "ACGNACGT"), ("s", "ACGTA")], "read_id string, seq string")
    good = reads.read_filter(raw, 5)
    assert [tuple(x) for x in reads.read_dedup(good).collect()] == [("r1", "AACCGGTA", 3.0)]
    assert tuple(reads.read_metrics(raw, 5).first()) == (5, 1, 1, 3, 24)
    assert [tuple(x) for x in reads.redundant_removal(reads.mark_contained(good)).collect()] == [("r1", "AACCGGTA", 3.0)]


def test_tips_and_islands(spark):
    nodes = spark.createDataFrame([("h", "A" * 900, 9.0), ("t1", "A" * 40, 1.0), ("t2", "A" * 50, 1.0), ("x", "A" * 900, 9.0), ("t3", "A" * 60, 1.0), ("i", "A" * 30, 1.0), ("u", "A" * 30, 1.0), ("v", "A" * 31, 1.0)], NODES)
    edges = spark.createDataFrame(both([("h", "f", "t1", "f", 20), ("h", "f", "t2", "f", 20), ("h", "r", "x", "r", 20), ("h", "r", "t3", "f", 20), ("u", "f", "v", "f", 20)]), EDGES)
    got = {r.node_id: r.kind for r in simplify.tips(nodes, edges, 360).collect()}
    assert got == {"t1": "clipped", "t2": "kept", "t3": "clipped", "i": "island", "u": "clipped", "v": "clipped"}
    n, e = simplify.remove_tips(nodes, edges, 360)
    assert {r.node_id for r in n.collect()} == {"h", "t2", "x"} and e.count() == 4


def test_bubble(spark):
    rng = random.Random(1)
    a, z, inner = ("".join(rng.choices("ACGT", k=n)) for n in (100, 100, 40))
    other = inner[:20] + ("A" if inner[20] != "A" else "C") + inner[21:]
    arms = [("p", a[-20:] + inner + z[:20], 5.0), ("q", a[-20:] + other + z[:20], 2.0), ("w", a[-20:] + "ACGT" * 10 + z[:20], 9.0)]
    nodes = spark.createDataFrame([("a", a, 9.0), ("z", z, 9.0), *arms], NODES)
    edges = spark.createDataFrame(both([e for i, _, _ in arms for e in (("a", "f", i, "f", 20), (i, "f", "z", "f", 20))]), EDGES)
    n, e, gone = simplify.pop_bubbles(nodes, edges, 100)
    assert [tuple(r) for r in gone.collect()] == [("p", "q", 80.0)]
    assert {r.node_id: r.cov for r in n.collect()} == {"a": 9.0, "z": 9.0, "w": 9.0, "p": 6.0} and e.count() == 8


def test_greedy_popping(spark):
    rng = random.Random(6)
    names = [f"n{i:02d}" for i in range(30)]
    pairs = sorted({tuple(sorted(rng.sample(names, 2))) for _ in range(70)})
    want, down = {}, set()
    for u in names:
        if u not in down:
            for v in [b for a, b in pairs if a == u]:
                if v not in down:
                    down.add(v)
                    want[v] = u
    got = {r.v: r.u for r in simplify.popped(spark.createDataFrame([(a, b, 1.0, 2.0) for a, b in pairs], "u string, v string, extra double, u_cov double")).collect()}
    assert got == want


def test_low_coverage_and_statistic(spark):
    nodes = spark.createDataFrame([("a", "A" * 51, 1.0), ("b", "A" * 52, 1.0), ("c", "A" * 100, 1.0)], NODES)
    n, _ = simplify.remove_low_coverage(nodes, spark.createDataFrame([], EDGES), read_len=36, k=21)
    assert {r.node_id for r in n.collect()} == {"b", "c"}
    r = repeats.a_statistic(nodes.filter("node_id = 'c'"), read_len=36, k=21).first()
    assert round(r.a_stat, 2) == 185.57 and r.is_unique


def test_n50(spark):
    nodes = spark.createDataFrame([("a", "A" * 500, 1.0), ("b", "A" * 300, 2.0), ("c", "A" * 200, 1.0), ("d", "A" * 30, 1.0)], NODES)
    got = {r.cutoff: (r.n50, r.n50cnt) for r in stats.n50(nodes).collect()}
    assert got == {1: (300, 2), 50: (500, 1), 100: (500, 1), 250: (500, 1), 500: (500, 1)}
    assert [tuple(r) for r in stats.top_contigs(nodes).collect()] == [(1, 500, 500), (2, 300, 800), (3, 200, 1000)]
    assert tuple(stats.global_n50(nodes, 1800).first()) == (1800, "200", "3") and tuple(stats.global_n50(nodes, 9000).first()) == (9000, "<100", ">3")
    row = {r.cutoff: r for r in stats.graph_stats(nodes, spark.createDataFrame([], EDGES)).collect()}[250]
    assert (row.cnt, row["sum"], row.mean, row.deg, row["cov"]) == (2, 800, 400.0, 0.0, 1.38)


def test_formats(spark, tmp_path):
    (tmp_path / "a.fa").write_text("# c\n>r:1 x\nACG\nTTa\n\n>r-2\nGG\n")
    (tmp_path / "a.fq").write_text("@q1 z\nacgt\n+\n@@@@\n@q2\nTT\n+q2\n@I\n")
    assert [tuple(r) for r in formats.read_fasta(spark, str(tmp_path / "a.fa"), "_s").collect()] in ([("r_1_s", "ACGTTA"), ("r_2_s", "GG")],)
    assert sorted(tuple(r) for r in formats.read_fastq(spark, str(tmp_path / "a.fq")).collect()) == [("q1", "ACGT"), ("q2", "TT")]
    tags = [r.tag for r in formats.renumber(spark.createDataFrame([(f"t{i:03d}", "A") for i in range(40)], "tag string, seq string")).collect()]
    assert sorted(tags, key=lambda x: int(x, 16)) == [f"{i:X}" for i in range(1, 41)]
    nodes = spark.createDataFrame([("a", "ACGTA", 1.0), ("b", "C" * 130, 4.0)], NODES)
    edges = spark.createDataFrame(both([("a", "f", "b", "r", 3)]), EDGES)
    n, e = formats.parse_node_lines(formats.to_node_lines(nodes, edges))
    assert sorted(map(tuple, n.collect())) == sorted(map(tuple, nodes.collect())) and sorted(map(tuple, e.collect())) == sorted(map(tuple, edges.collect()))
    assert sorted(r.read_id for r in formats.to_sfa(nodes).collect()) == ["1_b", "2_b", "3_b", "a"]
    formats.write_fasta(nodes, str(tmp_path / "out"))
    back = formats.read_fasta(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, back.collect())) == [("a", "ACGTA"), ("b", "C" * 130)]


def test_more_files(spark, tmp_path):
    """Several paths in one read, k-mer lists, the statistics as text, counts of what is malformed."""
    for name, text in (("a", "@q1 z\nacgt\n+\n@@@@\n"), ("b", "@q2\nTT\n+\nII\n")):
        (tmp_path / f"{name}.fq").write_text(text)
        (tmp_path / f"{name}.fa").write_text(f">{name}\nACG\n")
        (tmp_path / f"{name}.sfa").write_text(f"{name}\tACGTAC\nbroken\n{name}2\tACGN\tx\n")
    both = lambda end: [str(tmp_path / f"{n}.{end}") for n in "ab"]
    assert sorted(map(tuple, formats.read_fastq(spark, both("fq")).collect())) == [("q1", "ACGT"), ("q2", "TT")]
    assert sorted(map(tuple, formats.read_fasta(spark, both("fa")).collect())) == [("a", "ACG"), ("b", "ACG")]
    lines = formats.read_sfa(spark, both("sfa"))
    assert reads.read_metrics(lines, 5).first().asDict() == {"input_lines_invalid": 2, "reads": 6, "reads_skipped": 2, "reads_short": 0, "reads_good": 2, "reads_goodbp": 12}
    pieces = spark.createDataFrame([("@q1 z\nacgt\n+\n",), ("@@@",), ("q2\nTT\n+q2\n",), ("I\n",), ("q3\nACGT\nACGT\n",)], "value string")
    assert tuple(formats.fastq_counts(pieces).first()) == (2, 1)
    formats.write_kmers(spark.createDataFrame([("ACGTA",), ("TTTTT",)], "kmer string"), str(tmp_path / "kmers"))
    assert sorted(r.kmer for r in formats.read_kmers(spark, str(tmp_path / "kmers")).collect()) == ["ACGTA", "TTTTT"]
    nodes = spark.createDataFrame([("a", "A" * 500, 1.0), ("b", "A" * 300, 2.0)], NODES)
    formats.write_stats(stats.graph_stats(nodes, spark.createDataFrame([], EDGES)), str(tmp_path / "stats"), stats.top_contigs(nodes), stats.global_n50(nodes, 800))
    (part,) = (tmp_path / "stats").glob("part-*")
    assert part.read_text().splitlines()[:2] == [">500\t1\t500\t500.00\t500\t1\t0.00\t1.00", ">250\t2\t800\t400.00\t500\t1\t0.00\t1.38"]
    assert part.read_text().splitlines()[-5:] == ["max_1:\t500\t500", "max_2:\t300\t800", "global_n50target:\t800", "global_n50:\t500", "global_n50cnt:\t1"]


def test_hamming_ratio(spark):
    df = spark.createDataFrame([("ACGT", "ACCTTT"), ("", "A"), ("AA", "CC")], "a string, b string")
    assert [r[0] for r in df.select(dna.hamming_ratio("a", "b")).collect()] == [0.25, None, 1.0]


def hub(n, rng):
    """A node with n neighbours on one side: reads that begin with its end and go on in many ways."""
    end = "".join(rng.choices("ACGT", k=30))
    tails = sorted({rng.choice("AAAAAAAACT") + "".join(rng.choices("ACGT", k=rng.randint(0, 11))) for _ in range(3 * n)})
    rng.shuffle(tails)
    nodes = [("hub", "".join(rng.choices("ACGT", k=40)) + end, 3.0)] + [(f"t{i:05d}", end[rng.randint(0, 8) :] + t, float(rng.randint(1, 4))) for i, t in enumerate(tails[:n])]
    edges = [("hub", "f", i, "f", next(k for k in range(30, 20, -1) if s.startswith(end[30 - k :]))) for i, s, _ in nodes[1:]]
    return nodes, edges


def test_hub_of_very_many_edges(spark):
    """Reduction and votes on a side of 10,000 edges: no pairs of edges are made, and the result is that of the definition."""
    nodes, edges = hub(10_000, random.Random(5))
    n, e = spark.createDataFrame(nodes, NODES), spark.createDataFrame(both(edges), EDGES)
    ext = {d: (s[o:], o, len(s)) for (_, _, d, _, o), (_, s, _) in zip(edges, nodes[1:])}
    packed = lambda k: (k + 1) // 2
    by_text = {}
    for d, (t, o, size) in ext.items():
        by_text.setdefault(t, []).append((o, size, d))
    implied = set()
    for d, (t, o, size) in ext.items():
        for k in range(len(t) + 1):
            for o2, size2, d2 in by_text.get(t[:k], ()):
                if (o2, size2) != (o, size) and (o2 > o or (o2 == o and (packed(size2), d2) < (packed(size), d) and (packed(size2) < packed(size) or d2 < d))):
                    implied.add(d)
    got = {r.dst for r in graph.transitive_marks(e, n).filter("src = 'hub'").collect()}
    assert got == implied and len(got) > 1000
    weights = {i: int(c) for i, _, c in nodes}
    order = sorted(ext, key=lambda d: (-len(ext[d][0]), d))
    length = len(ext[order[1]][0]) if nodes[0] and weights[order[0]] + weights[order[1]] > 2 else len(ext[order[2]][0])
    won = []
    for p in range(length):
        votes = {}
        for d, (t, _, _) in ext.items():
            if p < len(t):
                votes[t[p]] = votes.get(t[p], 0) + weights[d]
        best = max(votes, key=votes.get)
        won.append(best if votes[best] / sum(votes.values()) > 0.6 else None)
    marks = {r.dst for r in consensus.chimeric_marks(e, n, majority=0.6, pwm_n=1.0).filter("src = 'hub'").collect()}
    assert marks == {d for d, (t, _, _) in ext.items() if any(w and c != w for c, w in zip(t, won))}


def test_counters_and_statistics_of_an_assembly(spark):
    rng = random.Random(2)
    genome = "".join(rng.choices("ACGT", k=600))
    rows = [(f"r{i:03d}", genome[a : a + 36]) for i, a in enumerate(range(0, 560, 4))] + [("bad", "ACGNNN"), ("short", "ACGT"), ("r000b", genome[:36])]
    g = assemble(spark.createDataFrame(rows, "read_id string, seq string"), Config(k=21, read_len=36, stage_stats=True))
    m = {(s, k): v for s, k, v in g.metrics}
    assert (m["reads", "reads"], m["reads", "reads_skipped"], m["reads", "reads_short"], m["reads", "contained"], m["reads", "nodecount"]) == (len(rows), 1, 1, 1, 140)
    assert m["string", "trans_edge"] > 0 and m["string", "chains"] == 1 and m["string", "saved"] == 139 and m["tips", "tips_island"] == 0
    assert {"potentialbubbles", "bubbleschecked", "lowcovremoved", "lowcoverage_island", "linksremoved", "unique", "repeat", "hkmer", "braids", "tips_shorttandem"} <= {k for _, k in m}
    found = g.stats_table(spark).collect()
    assert {r.stage for r in found} == {"overlap", "string", "tips", "bubbles", "lowcov", "adjust"}
    assert max(r["sum"] for r in found if r.stage == "adjust" and r.cutoff == 500) == len(g.nodes.first().seq)
    assert g.metrics_table(spark).count() == len(g.metrics)


def test_config():
    assert Config(k=21, read_len=36).tips == 360 and Config(k=21, read_len=36).bubble == 101
    for bad in ({"k": 20, "read_len": 36}, {"k": 21, "read_len": 21}):
        try:
            Config(**bad)
        except ValueError:
            continue
        raise AssertionError(bad)
