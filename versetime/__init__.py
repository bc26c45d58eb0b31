"""versetime: time-coded text and audio metadata as Spark DataFrames."""
