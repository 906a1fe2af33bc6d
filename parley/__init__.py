"""A PySpark-native analytics engine for earnings-call transcripts and the data around them."""
