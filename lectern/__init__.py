"""lectern: a Spark-native engine for corpus question analytics."""
