"""Operators: DataFrame(s) in, DataFrame out. None of them triggers a job."""
