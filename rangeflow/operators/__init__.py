"""Operators over an index space: binding, cuts, ranges, reductions, kernels, decisions."""
