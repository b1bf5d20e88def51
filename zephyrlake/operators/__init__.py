"""Contracts, grid statistics, wind vectors, pooling, imputation, forests, scores and audits."""
