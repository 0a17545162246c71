"""Text association and clustering over DataFrames."""
