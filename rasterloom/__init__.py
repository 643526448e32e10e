"""Images, voxel grids and sequences as DataFrames."""
