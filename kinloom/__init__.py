"""kinloom: segments of shared descent in phased panels, planned by Spark."""
