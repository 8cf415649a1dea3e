"""The formula language: tokens, references, patterns, evaluation. Plain Python, run on distinct formulas only."""
