"""repeatlake: k-mer, tandem-repeat and corpus analytics expressed as Spark plans."""
