"""Sources: MatrixMarket files and synthetic matrices."""
