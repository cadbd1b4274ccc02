"""Partitioning helpers shared by the operators: ranks, blocks, durability."""
