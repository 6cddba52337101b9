"""From SQL text to DataFrames: parser, typed expressions, analyzer, planner."""
