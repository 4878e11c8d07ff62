"""Hydrological time series, ensembles and rasters as Spark plans."""
