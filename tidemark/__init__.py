"""tidemark: signal analytics over ranked lists, feeds and corpora, as Spark jobs."""
