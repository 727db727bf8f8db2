"""Column expressions: intervals, CIGAR arrays, statistics and scores."""
