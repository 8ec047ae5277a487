"""freightlens: shipment graphs, quarterly features and classifiers as Spark jobs."""
