"""voxelweave.operators"""
