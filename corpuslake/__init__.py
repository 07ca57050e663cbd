"""corpuslake: building, searching and scoring large text corpora on Spark DataFrames."""
