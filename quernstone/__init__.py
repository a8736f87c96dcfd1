"""quernstone: curated-reference analytics and corpus preparation on PySpark."""
