"""tomar: document intelligence over collections of official correspondence, as Spark plans."""
