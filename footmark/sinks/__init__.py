"""Writers: replace, publish and export."""
