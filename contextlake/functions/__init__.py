"""Column functions and driver-side text helpers."""
