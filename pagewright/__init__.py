"""Document-layout analytics on Spark: glyphs, words and lines in, structured documents out."""
