"""textward.streaming"""
