"""Mining operators over DataFrames."""
