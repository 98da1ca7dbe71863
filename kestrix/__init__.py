"""kestrix: mixed-effect GLM analytics expressed as Spark DataFrame plans."""
