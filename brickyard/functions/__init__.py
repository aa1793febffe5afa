"""Part of the brickyard engine."""
