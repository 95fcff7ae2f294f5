"""Cryptography inventory, migration risk and corpus preparation as Spark jobs."""
