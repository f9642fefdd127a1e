"""acervo: a Spark-native engine that ingests, classifies, archives, searches and cleans document collections."""
