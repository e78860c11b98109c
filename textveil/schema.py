"""Schemas of the engine's tables, as Spark DDL."""

DETECTION = "struct<type:string,value:string,start:int,end:int,confidence:double,rule:string>"
PACKET = "packet_no int, src string, dst string, text string"
COMPLETION = "struct<ok:boolean,text:string,model:string,raw:string>"
