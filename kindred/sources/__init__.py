"""Readers and writers of genotype, frequency and report files."""
