"""Operators of a training-data pipeline. Nothing else in voxelweave imports this package."""
