"""voxelweave: region, point and metric-table analytics as Spark DataFrame jobs."""
