"""segflow: timed transcripts as DataFrames over a whole corpus."""
