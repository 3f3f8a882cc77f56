"""Document fact extraction and corpus preparation as Spark DataFrame programs."""
