"""loomtext: multilingual text analytics as Spark DataFrame functions."""
