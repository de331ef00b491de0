"""Incremental reading of genotype files. The studied pipeline has no stream operators; this serves new files only."""
