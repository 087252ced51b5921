"""DataFrame operators: profiling, detection, scoring, repair, text and similarity."""
