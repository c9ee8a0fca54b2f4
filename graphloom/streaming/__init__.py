"""Result cursors, cancellation and incremental edge feeds."""
