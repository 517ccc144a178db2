"""flowsieve: Spark-native evaluation analytics for labelled event tables."""
