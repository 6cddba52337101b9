"""Operations of a large-scale training-data pipeline, each a set of functions over DataFrames."""
