"""Where rows come from and where versions are kept."""
