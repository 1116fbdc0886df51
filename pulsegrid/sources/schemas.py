"""Explicit schemas of the canonical event and the collection envelope; nothing is inferred."""

from __future__ import annotations

VERSION = "1.0.0"
PLATFORMS = ("x", "reddit", "telegram")

URL = "struct<raw:string,resolved:string,domain:string,resolutionStatus:string>"
ATTACHMENT = "struct<type:string,url:string,mediaId:string,order:int,altText:string,width:int,height:int,durationMillis:bigint>"
REACTION = "struct<emoji:string,count:bigint>"
PLATFORM_DATA = (
    "struct<possiblySensitive:boolean,isEdited:boolean,authorFollowers:bigint,authorVerified:boolean,subreddit:string,subredditId:string,score:bigint,upvoteRatio:double,"
    "domain:string,isSelf:boolean,isVideo:boolean,over18:boolean,stickied:boolean,locked:boolean,spoiler:boolean,distinguished:string,permalink:string,postHint:string,depth:int,"
    f"peerKind:string,peerId:string,channelId:string,channelUsername:string,channelTitle:string,forwards:bigint,reactionsTotal:bigint,reactions:array<{REACTION}>>"
)
EVENT = (
    "struct<eventId:string,platform:string,platformPostId:string,"
    "source:struct<sourceLayer:string,retrievalQuery:string,discoveredTrend:string,observedAt:string,collectedAt:string,collectorVersion:string>,"
    f"content:struct<text:string,title:string,language:string,detectedLang:string,languageDetectionConfidence:double,hashtags:array<string>,mentions:array<string>,urls:array<{URL}>,attachments:array<{ATTACHMENT}>,contentFingerprint:string>,"
    "author:struct<authorId:string,authorHandle:string,authorName:string,authorBio:string,authorLocation:string>,"
    "time:struct<publishedAt:string,observedAt:string,editedAt:string>,"
    "engagement:struct<likes:bigint,replies:bigint,reposts:bigint,quotes:bigint,bookmarks:bigint,views:bigint,impressions:bigint>,"
    "relationships:struct<replyToId:string,replyToAuthorId:string,quoteOfId:string,forwardOfId:string,conversationId:string,crosspostOfId:string>,"
    f"platformData:{PLATFORM_DATA},retrieval:struct<matchType:string,matchedTerms:array<string>>>"
)
PAGINATION = "struct<requestedLimit:int,primaryResultsReturned:int,relationshipRecordsCollected:int,recordsCollected:int,pagesFetched:int,hasMore:boolean,stoppedBecause:string>"
ENVELOPE = (
    "schemaVersion string, collection struct<collectionId:string,platformsRequested:array<string>,startedAt:string,completedAt:string>, "
    "trend struct<trendId:string,label:string,query:string,rank:int,volume:bigint,volumeSource:string,discoveredAt:string>, "
    f"platforms map<string,struct<status:string,pagination:{PAGINATION}>>, events array<{EVENT}>, "
    "authorProfiles array<struct<platform:string,authorId:string,authorHandle:string,authorName:string,followers:bigint>>, communities array<struct<id:string,name:string>>, "
    "quality struct<recordsCollected:int,warnings:array<string>,errors:array<string>>"
)
