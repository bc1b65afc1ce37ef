"""The counters of all operators over one set of reads, each taken by the tasks that write the operator's table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.operators import chains, consensus, graph, kmers, overlap, reads, simplify
from helixframe.plans.config import Config
from helixframe.plans.scratch import counted, cut


def quality_counts(nodes: DataFrame, cfg: Config, trust: int) -> dict[str, int]:
    """k-mers in all (allkmer) and those of coverage 2 or more (diffkmer), corrections (fix_char), and reads that aren't trusted (failed_reads)."""
    _, k = counted(kmers.kmer_count(nodes, cfg.k), "kmers", both=F.sum("cnt"), diffkmer=F.count_if(F.col("cnt") >= 2))
    _, fixes = counted(kmers.precorrect(nodes), "fixes")
    verdict = kmers.trusted_reads(kmers.read_kmer_freq(nodes, cfg.trust_k), trust)
    _, tagged = counted(kmers.tag_trusted(nodes, verdict), "tagged", failed=F.count_if(~F.col("is_trusted")))
    return {"allkmer": k["both"] // 2, "diffkmer": k["diffkmer"], "fix_char": fixes["n"], "failed_reads": tagged["failed"]}


def stage_counts(raw: DataFrame, cfg: Config, trust: int) -> DataFrame:
    """(stage, name, value): reads, k-mers, overlaps, transitive edges, chains, and one round each of tips, bubbles and low coverage on the contigs."""
    rows: list[tuple[str, str, int]] = []

    def note(stage: str, **numbers: int) -> None:
        rows.extend((stage, k, int(v or 0)) for k, v in numbers.items())

    nodes, seen = counted(reads.read_dedup(reads.read_filter(raw, cfg.k)), "nodes")
    found = reads.read_metrics(raw, cfg.k).first().asDict()
    note("reads", **found, contained=found["reads_good"] - seen["n"], nodecount=seen["n"])
    heavy = cut(kmers.heavy(nodes, cfg.k, cfg.up_kmer), "heavy")
    stop, listed = counted(kmers.high_kmers(nodes, cfg.k, cfg.up_kmer, among=heavy), "stop")
    note("kmers", hkmer=listed["n"], **quality_counts(nodes, cfg, trust))
    edges, led = counted(overlap.overlaps(nodes, cfg.k, stop=stop, heavy=heavy, up_kmer=cfg.up_kmer), "edges")
    note("overlap", nodes=seen["n"], edges=led["n"])
    size = nodes.select(F.col("node_id").alias("src"), F.length("seq").alias("a")), nodes.select(F.col("node_id").alias("dst"), F.length("seq").alias("b"))
    spans = edges.join(size[0], "src").join(size[1], "dst").select("src", F.col("ovl").alias("o"), "a", "b")
    _, whole = counted(spans.filter("o = a AND o = b"), "contained")
    reduced, left = counted(graph.transitive_reduction(edges, nodes), "reduced")
    note("string", contained_edge=whole["n"], trans_edge=led["n"] - left["n"])
    link, compressible = counted(graph.compressible(reduced), "links")
    _, near = counted(graph.compress_neighborhood(reduced), "near", own=F.count_if("is_compressible"))
    merged, links = chains.merged_chains(nodes, reduced, link=link)
    chain = F.col("members") > 1
    contigs, made = counted(merged, "contigs", chains=F.count_if(chain), members=F.sum(F.when(chain, F.col("members"))))
    links, out = counted(links, "links")
    _, again = counted(graph.compressible(links).select("src").distinct(), "again")
    note("chains", compressible=compressible["n"], compressibleneighborhood=near["own"], chains=made["chains"], cchains=made["chains"], totalchainlen=made["members"], saved=made["members"] - made["chains"], needscompress=again["n"], nodes=made["n"], edges=out["n"])
    colors = cut(consensus.define_consensus(reduced, nodes), "colors")
    note("string", braids=consensus.count_braids(reduced, nodes, colors).first()["braids"])
    _, tips = counted(simplify.tips(contigs, links, cfg.tips), "tips", **{k: F.count_if(F.col("kind") == k) for k in ("kept", "clipped", "island", "tandem")})
    note("tips", tips_found=tips["n"], tips_island=tips["island"], tips_shorttandem=tips["tandem"], tips_kept=tips["kept"], tips_clipped=tips["clipped"])
    arms, some = counted(simplify.bubble_arms(contigs, links, cfg.bubble), "arms")
    _, groups = counted(arms.groupBy(*simplify.BUBBLE).agg(F.count("*").alias("c")), "bubbles", pairs=F.sum(F.expr("c * (c - 1) div 2")))
    _, popped = counted(simplify.popped_arms(arms, cfg.bubble_edit_rate), "popped")
    note("bubbles", potentialbubbles=some["n"], bubbleschecked=groups["pairs"], bubblespopped=popped["n"])
    low, gone = counted(simplify.low_coverage(contigs, read_len=cfg.read_len, k=cfg.k, threshold=cfg.low_cov), "low")
    _, alone = counted(low.join(links.select(F.col("src").alias("node_id")), "node_id", "left_anti"), "alone")
    _, rest = counted(graph.node_removal(contigs, links, low)[1], "rest")
    note("lowcov", lowcovremoved=gone["n"], lowcoverage_island=alone["n"], linksremoved=out["n"] - rest["n"])
    return raw.sparkSession.createDataFrame(rows, "stage string, name string, value long")
