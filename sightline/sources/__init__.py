"""Readers and writers: projected scans, products with contracts, raster tiles and vector records."""
