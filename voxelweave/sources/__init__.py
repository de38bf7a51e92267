"""voxelweave.sources"""
