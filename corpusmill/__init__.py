"""corpusmill: labelled-text corpus construction, screening and evaluation on Spark."""
