"""Readers and writers: FASTA, FASTQ, tab-separated reads, node lines."""
