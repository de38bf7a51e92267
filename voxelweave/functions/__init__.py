"""voxelweave.functions"""
