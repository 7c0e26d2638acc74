"""lodestone.streaming"""
