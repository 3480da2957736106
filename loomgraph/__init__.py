"""loomgraph: Spark-first operators for building and auditing knowledge graphs."""
