"""seamline: similarity, session, fusion and clustering operators as Spark plans."""
