"""DataFrame operators: profiling, rules, cleaning, comparison and scoring."""
