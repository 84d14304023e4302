"""siteweave: genomic variant tables on Spark."""
