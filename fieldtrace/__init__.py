"""Signal-map analytics on Spark: parsing, alignment, maps, matching, localisation and evaluation as DataFrame plans."""
