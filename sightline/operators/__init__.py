"""DataFrame operators: kernels, composition, checks, summaries, rays, grids and sampling."""
